"""Hand-drawn models: a reader of nested blocks for diagram sources and workspaces, and the context view."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from lodestone.sources.files import parsed

# Words that declare elements, and blocks that are taken as they stand.
ELEMENTS = ("person", "softwareSystem", "container", "component")
VERBATIM = ("views", "styles")
DRAWN = "path string, kind string, key string, name string, description string, technology string, parent string, position int"

_TOKEN = re.compile(
    r"""(?P<comment>/\*.*?(?:\*/|\Z)|//[^\n]*|(?<![^\n])[ \t]*\#[^\n]*)|"(?P<string>(?:[^"\\]|\\.)*)"|(?P<arrow>->)|(?P<mark>[{}=\n])|(?P<word>[^\s{}="]+?(?=->|[\s{}="]|\Z))""",
    re.S,
)


def _slug(name: str) -> str:
    return re.sub("[^0-9A-Za-z]+", "-", name).strip("-").lower() or "element"


def _block_end(text: str, at: int) -> int:
    """Where the block closes whose opening brace ends before ``at``; the end of the text if it never does."""
    depth = 1
    for m in _TOKEN.finditer(text, at):
        depth += {"{": 1, "}": -1}.get(m["mark"], 0)
        if not depth:
            return m.start()
    return len(text)


def _statements(text: str) -> Iterator[tuple[list[tuple[str, str]], str, int, int]]:
    """Statements: their tokens as (kind, value), what ends them (a brace, a line end or nothing), begin and end."""
    held: list[tuple[str, str]] = []
    at, begin = 0, 0
    while m := _TOKEN.search(text, at):
        at = m.end()
        if m["comment"] is not None:
            continue
        if m["mark"] in ("{", "}", "\n"):
            yield held, m["mark"], begin, at
            # The reader may have moved on past a block.
            if m["mark"] == "{" and len(held) == 1 and held[0][1].lower() in VERBATIM:
                at = min(len(text), _block_end(text, at) + 1)
            held = []
            continue
        if not held:
            begin = m.start()
        kind = m.lastgroup
        held.append((kind, re.sub(r"\\(.)", r"\1", m["string"], flags=re.S) if kind == "string" else m[kind]))
    yield held, "", begin, len(text)


def diagram(path: str, text: str) -> Iterator[tuple]:
    """Rows of a diagram source, ``DRAWN``.

    Kinds are those of elements; ``group``; ``relation`` (``key`` leads to ``name``, as identifiers; within
    an element's block the source may be left out); and ``views`` and ``styles``, whose source stands in
    ``description``. ``parent`` is the name of the nearest group or element around. An element without an
    identifier has a slug of its name as its key. Lines that begin with ``!``, comments and unknown blocks
    are passed over, braces in names and comments don't count.
    """
    around: list[tuple[str, str]] = []  # name and identifier of the blocks that are open
    for held, end, begin, at in _statements(text):
        words = [v for k, v in held if k != "string"]
        strings = [v for k, v in held if k == "string"]
        parent = next((name for name, _ in reversed(around) if name), "")
        opened = ("", "")
        if held and held[0][0] == "word" and held[0][1].startswith("!"):
            pass
        elif "->" in words:
            cut = words.index("->")
            source = words[cut - 1] if cut else next((key for _, key in reversed(around) if key), None)
            if source and len(words) > cut + 1:
                yield path, "relation", source, words[cut + 1], strings[0] if strings else "", strings[1] if len(strings) > 1 else "", parent, begin
        elif words[:1] == ["group"] and strings:
            yield path, "group", _slug(strings[0]), strings[0], "", "", parent, begin
            opened = (strings[0], "")
        elif words and words[0].lower() in VERBATIM and len(held) == 1 and end == "{":
            yield path, words[0].lower(), "", "", text[at : _block_end(text, at)].lstrip("\r\n").rstrip(), "", parent, begin
            continue
        else:
            ident, kind = (words[0], words[2]) if words[1:2] == ["="] and len(words) > 2 else ("", words[0] if words else "")
            if kind in ELEMENTS:
                name = strings[0] if strings else ident
                key = ident or _slug(name)
                yield path, kind, key, name, strings[1] if len(strings) > 1 else "", strings[2] if len(strings) > 2 else "", parent, begin
                opened = (name or key, key)
        if end == "{":
            around.append(opened)
        elif end == "}" and around:
            around.pop()


def workspace(path: str, text: str) -> Iterator[tuple]:
    """Rows of a model written as JSON: people, systems, their containers and components; views and styles as stable JSON."""
    whole = json.loads(text.removeprefix("﻿"))
    model, place = whole.get("model") or {}, 0
    todo = [("person", x, "") for x in model.get("people") or []] + [("softwareSystem", x, "") for x in model.get("softwareSystems") or []]
    while todo:
        kind, node, parent = todo.pop(0)
        if not isinstance(node, dict):
            continue
        text_of = lambda field: str(node.get(field) or "")  # noqa: E731, B023
        name, own = text_of("name"), text_of("group")
        if own:
            yield path, "group", _slug(own), own, "", "", parent, place
        yield path, kind, text_of("id") or name or _slug(name), name, text_of("description"), text_of("technology"), own or parent, place
        for relation in node.get("relationships") or []:
            yield path, "relation", text_of("id"), str(relation.get("destinationId") or ""), str(relation.get("description") or ""), str(relation.get("technology") or ""), own or parent, place
        place += 1
        todo[:0] = [(k, child, own or name or parent) for k, field in (("container", "containers"), ("component", "components")) for child in node.get(field) or []]
    stable = lambda x: json.dumps(x, sort_keys=True, ensure_ascii=False, indent=2)
    views = whole.get("views") or {}
    styles = (whole.get("configuration") or {}).get("styles") or (views.get("configuration") or {}).get("styles")
    for kind, found in (("views", views), ("styles", styles)):
        if found:
            yield path, kind, "", "", stable(found), "", "", place


def drawn(files: DataFrame) -> DataFrame:
    """``DRAWN`` of hand-drawn models (``path, text``), JSON by their ending; equal elements of one parent count once, the first."""
    rows = parsed(files, lambda path, text: (workspace if path.lower().endswith(".json") else diagram)(path, text), DRAWN)
    keys = ["path", "kind", "key", "name", "parent"]
    first = F.min_by(F.struct("description", "technology", "position"), "position")
    return rows.where("kind <> 'relation'").groupBy(*keys).agg(first.alias("x")).select("path", "kind", "key", "name", "x.description", "x.technology", "parent", "x.position").unionByName(rows.where("kind = 'relation'"))


def seed_rules(rows: DataFrame, source: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """First rules from a drawn model: display names and descriptions by key, containers (groups and parents), and a row of provenance.

    The keys are the drawn ones; binding them to extracted targets is what ``ownership`` proposes.
    """
    own = rows.where(F.col("kind").isin(*ELEMENTS))
    last = lambda c: F.max_by(F.nullif(c, F.lit("")), F.when(F.col(c) != "", F.struct("parent", "key", "name")))
    names = own.groupBy("key").agg(last("name").alias("name"), last("description").alias("description"))
    groups = rows.where("kind = 'group'").select(F.col("name").alias("container")).unionByName(own.where("parent <> ''").select(F.col("parent").alias("container"))).distinct()
    marks = rows.agg(F.coalesce(F.bool_or(F.col("kind").isin(*VERBATIM) & (F.col("description") != "")), F.lit(False)).alias("imported_views"))
    return names, groups, marks.select(F.lit(source).alias("from"), "imported_views", F.lit("pending").alias("id_reconciliation"))


def context_view(rows: DataFrame, nodes: DataFrame, calls: DataFrame, system: str = "system", label: str = "System") -> tuple[DataFrame, DataFrame]:
    """Nodes (``id, label, kind, external, tech, description``) and edges (``source, target, kind, label``) of the context view.

    People and systems come from the drawn model, where ``system`` is the identifier of the system itself;
    external infrastructure from deployment ``nodes`` (``id, name, kind, technology, external``). The system
    calls such a node only where a deployed image does (``calls``: ``source, target, kind``). Raises where
    there is nothing beside the system.
    """
    people = rows.where(F.col("kind").isin("person", "softwareSystem")).groupBy("key", "kind").agg(F.min_by("name", "position").alias("name"), F.min_by("description", "position").alias("description"))
    inner = (F.col("kind") == "softwareSystem") & (F.col("key") == system)
    node_id = F.when(inner, F.lit("system")).otherwise(F.concat(F.when(F.col("kind") == "person", "dsl:person:").otherwise("dsl:system:"), "key"))
    named = people.withColumn("id", node_id)
    none = F.lit(None).cast("string")
    told = F.when(F.col("kind") == "person", F.nullif("description", F.lit(""))).alias("description")
    drawn_nodes = named.select("id", F.col("name").alias("label"), F.when(F.col("kind") == "person", "person").otherwise("system").alias("kind"), ((F.col("kind") != "person") & ~inner).alias("external"), none.alias("tech"), told)
    spark = rows.sparkSession
    own = spark.range(1).select(F.lit("system").alias("id"), F.lit(label).alias("label"), F.lit("system").alias("kind"), F.lit(False).alias("external"), none.alias("tech"), none.alias("description"))
    own = own.join(drawn_nodes.select("id"), "id", "left_anti")
    outer = nodes.where("kind = 'infra' AND external")
    infra = outer.select("id", F.coalesce("name", "id").alias("label"), F.lit("infra").alias("kind"), F.lit(True).alias("external"), F.col("technology").alias("tech"), none.alias("description"))
    found = drawn_nodes.unionByName(own).unionByName(infra)
    if found.limit(2).count() < 2:
        raise ValueError("no people, other systems or outer infrastructure: a view of one box is none")
    idents = named.select(F.col("key").alias("_key"), "id")
    used = rows.where("kind = 'relation' AND key <> name").select(F.col("key").alias("a"), F.col("name").alias("b"), F.col("description").alias("label"))
    implied = spark.range(1).select(F.lit(system).alias("_key"), F.lit("system").alias("id")).join(idents.select("_key"), "_key", "left_anti")
    every = idents.unionByName(implied)
    ends = used.join(every.select(F.col("_key").alias("a"), F.col("id").alias("source")), "a").join(every.select(F.col("_key").alias("b"), F.col("id").alias("target")), "b")
    uses = ends.select("source", "target", F.lit("uses").alias("kind"), F.nullif("label", F.lit("")).alias("label"))
    reached = calls.where(F.startswith("source", F.lit("deploy:image:")) & (F.col("kind") != "packages")).select(F.col("target").alias("id")).distinct()
    called = outer.join(reached, "id", "left_semi").select(F.lit("system").alias("source"), F.col("id").alias("target"), F.lit("calls").alias("kind"), none.alias("label"))
    return found, uses.unionByName(called)
