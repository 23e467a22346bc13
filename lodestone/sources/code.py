"""Facts in source text: includes and names, language boundaries, contracts, hosts and records."""

from __future__ import annotations

import json
import posixpath
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F



def blank_comments(text: str) -> str:
    """C-like text with comments and strings that look like attributes blanked, line ends kept."""
    out, at, size = [], 0, len(text)
    while at < size:
        two = text[at : at + 2]
        if two == "//":
            end = text.find("\n", at)
            end = size if end < 0 else end
        elif two == "/*":
            end = text.find("*/", at + 2)
            end = size if end < 0 else end + 2
        elif text[at] in "\"'":
            end = at + 1
            while end < size and text[end] != text[at] and text[end] != "\n":
                end += 2 if text[end] == "\\" else 1
            end = min(size, end + 1)
            if "[" not in text[at:end] and "Import" not in text[at:end]:
                out.append(text[at:end])
                at = end
                continue
        else:
            out.append(text[at])
            at += 1
            continue
        out.append(re.sub(r"[^\n]", " ", text[at:end]))
        at = end
    return "".join(out)


INTEROP = "path string, kind string, name string, position int"


def interop(path: str, text: str) -> Iterator[tuple]:
    """Boundaries of one C# or C++ file: native imports, COM classes and program ids, type libraries."""
    plain = blank_comments(text)
    if path.endswith(".cs"):
        for m in re.finditer(r"\[\s*(?:DllImport|LibraryImport)\s*\(\s*\"([^\"]+)\"", plain):
            yield path, "native", m[1], m.start()
        for m in re.finditer(r"\[\s*ComImport", plain):
            near = plain[max(0, m.start() - 160) : m.end() + 160]
            if guid := re.search(r"Guid\s*\(\s*\"([0-9A-Fa-f-]{36})\"", near):
                yield path, "com", guid[1].lower(), m.start()
        for m in re.finditer(r"GetTypeFromCLSID\s*\(\s*(?:new\s+Guid\s*\(\s*)?\"([^\"]+)\"", plain):
            yield path, "com", m[1].strip("{}").lower(), m.start()
        for m in re.finditer(r"GetTypeFromProgID\s*\(\s*\"([^\"]+)\"", plain):
            yield path, "com", m[1], m.start()
    else:
        for m in re.finditer(r"#import\s+[<\"]([^>\"]+)[>\"]", plain):
            yield path, "typelib", m[1], m.start()
        if re.search(r"\b(?:CoCreateInstance(?:Ex)?|CoGetClassObject)\b", plain):
            # Where objects are activated, the named class identities say which.
            for m in re.finditer(r"\bCLSID_([A-Za-z_]\w*)", plain):
                yield path, "com", m[1], m.start()
        for m in re.finditer(r"CLSIDFromProgID\s*\(\s*L?\"([^\"]+)\"", plain):
            yield path, "com", m[1], m.start()
        for m in re.finditer(r"#using\s+[<\"]([^>\"]+)\.dll[>\"]", plain):
            yield path, "managed", m[1], m.start()


# Contract files by extension.
CONTRACTS = {".proto": "protobuf", ".thrift": "thrift", ".idl": "idl", ".avsc": "avro", ".graphql": "graphql", ".wsdl": "wsdl"}


def contract_references(sources: DataFrame, contracts: DataFrame) -> DataFrame:
    """``path, contract`` of sources that name a contract's file, its generated header or module.

    The words of each source meet the names in an equi-join; no source is scanned once per contract.
    """
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]+$", "")
    named = contracts.select(F.col("path").alias("contract"), F.explode(F.array(F.element_at(F.split("path", "/"), -1), F.concat(stem, F.lit(".pb.h")), F.concat(stem, F.lit("_pb2")), F.concat(stem, F.lit("_types.h")))).alias("word"))
    words = sources.select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([\w./-]+)")))).alias("raw")).select("path", F.element_at(F.split("raw", "/"), -1).alias("word")).distinct()
    return words.join(named, "word").select("path", "contract").distinct()


def plugin_type(name: Column) -> Column:
    """Part of a dotted name after the first Plugin or Plugins."""
    parts = F.split(name, r"\.")
    at = F.array_min(F.filter(F.transform(parts, lambda p, i: F.when(p.isin("Plugin", "Plugins"), i)), lambda i: i.isNotNull()))
    return F.get(parts, at + 1)


def primary_category(files: DataFrame) -> DataFrame:
    """Most frequent category literal of each manifest, ties to the first."""
    found = files.select("path", F.posexplode(F.regexp_extract_all("text", F.lit(r'Category\s*=\s*"([^"]+)"'))).alias("at", "category"))
    counted = found.groupBy("path", "category").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    return counted.groupBy("path").agg(F.max_by("category", F.struct("n", -F.col("first"))).alias("category"))


DOXYGEN = "path string, kind string, file string, name string, detail string"


def doxygen(path: str, text: str) -> Iterator[tuple]:
    """Includes of files, and classes with their namespace, of one documentation file."""
    for node in ET.fromstring(text).iter("compounddef"):
        name = node.findtext("compoundname") or ""
        place = node.find("location")
        file = place.get("file") if place is not None else None
        if node.get("kind") == "file":
            for include in node.findall("includes"):
                yield path, "include", file, include.text, include.get("local")
        elif node.get("kind") in ("class", "struct"):
            bare = strip_templates(name)
            yield path, "class", file, bare, namespace_of(bare)


def strip_templates(name: str) -> str:
    """A qualified name without its balanced template arguments."""
    out, depth = [], 0
    for c in name:
        depth += c == "<"
        if not depth:
            out.append(c)
        depth -= c == ">" and depth > 0
    return "".join(out)


def namespace_of(name: str) -> str | None:
    return name.rpartition("::")[0] or None


def common_directory(paths: list[str]) -> str:
    """Longest directory that all paths share."""
    parts = [posixpath.dirname(p).split("/") for p in paths]
    shared = 0
    while parts and all(len(p) > shared and p[shared] == parts[0][shared] for p in parts):
        shared += 1
    return "/".join(parts[0][:shared]) if parts else ""


def presets(own: dict, user: dict) -> dict[str, dict]:
    """Configure presets by name, the user's over the project's."""
    return {p["name"]: p for source in (own, user) for p in source.get("configurePresets") or []}


def preset_field(found: dict[str, dict], name: str, key: str, seen: frozenset[str] = frozenset()):
    """A field of a preset or of those it inherits from, in order; a loop ends the search."""
    preset = found.get(name)
    if preset is None or name in seen:
        return None
    if key in preset:
        return preset[key]
    parents = preset.get("inherits") or []
    for parent in [parents] if isinstance(parents, str) else parents:
        if (value := preset_field(found, parent, key, seen | {name})) is not None:
            return value
    return None


FILE_API = "path string, record string, id string, name string, kind string, value string"


def file_api(path: str, text: str) -> Iterator[tuple]:
    """Targets, their sources and dependencies, of one reply file of the build system's file interface."""
    reply = json.loads(text)
    if "sources" not in reply and "dependencies" not in reply:
        return
    id_, name, kind = reply["id"], reply["name"], reply.get("type")
    yield path, "target", id_, name, kind, common_directory([s["path"] for s in reply.get("sources", [])])
    for source in reply.get("sources", []):
        yield path, "source", id_, name, "generated" if source.get("isGenerated") else "plain", source["path"]
    for other in reply.get("dependencies", []):
        if other["id"] != id_:
            yield path, "dependency", id_, name, "public", other["id"]


COMPILE = "path string, file string, command string, directory string"


def compiler_calls(path: str, text: str) -> Iterator[tuple]:
    """Sources of the compiler's command lines in a build log."""
    directory = ""
    for line in text.splitlines():
        if m := re.search(r"Entering directory '([^']+)'", line):
            directory = m[1]
        if m := re.search(r"(?:^|[\\/\s\"])cl(?:\.exe)?\"?\s+(/c\b.*)", line, re.I):
            for word in re.findall(r'"[^"]+"|\S+', m[1]):
                if re.search(r"\.(?:c|cc|cpp|cxx)\"?$", word, re.I):
                    yield path, word.strip('"').replace("\\", "/"), m[1].strip(), directory


APPHOST = "path string, record string, a string, b string"


def app_host(path: str, text: str) -> Iterator[tuple]:
    """Resources that a host program declares, and the references and settings among declared ones."""
    plain = re.sub(r"//[^\n]*", "", text)
    statements = [s for s in plain.split(";") if "Add" in s or "With" in s]
    names: dict[str, str] = {}
    for s in statements:
        if m := re.search(r"(?:var\s+|\b)(\w+)\s*=\s*\w+\s*\.\s*Add(\w+?)(?:<[^>]*>)?\s*\(\s*\"([^\"]+)\"", s):
            names[m[1]] = m[3]
            yield path, "node", m[3], m[2]
    for s in statements:
        m = re.search(r"(?:(\w+)\s*=|^\s*(\w+)\s*\.)", s)
        owner = names.get((m[1] or m[2]) if m else "")
        for other in re.findall(r"WithReference\s*\(\s*(\w+)", s) if owner else ():
            if other in names:
                yield path, "calls", owner, names[other]
        for key in re.findall(r"WithEnvironment\s*\(\s*\"([^\"]+)\"", s) if owner else ():
            yield path, "runtime_config", owner, key


def decision_record(path: str, text: str) -> Iterator[tuple]:
    """``path, id, title, status`` of a decision record in Markdown."""
    title = re.search(r"^#\s+(?:\d+[.:]?\s+)?(.+?)\s*$", text, re.M)
    status = re.search(r"^##\s*Status\s*\n+\s*([A-Za-z]+)|^\*{0,2}Status\*{0,2}\s*:\s*\**([A-Za-z]+)", text, re.M | re.I)
    number = re.match(r"(\d+)", posixpath.basename(path))
    yield path, number[1] if number else posixpath.splitext(posixpath.basename(path))[0], title[1] if title else "", ((status[1] or status[2]).lower() if status else None)


RECORD = "path string, id string, title string, status string"


def merged_sidecars(files: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """File owners of several sidecars (``sidecar, file, owner``): the first non-null by sidecar name, with a conflict mark; edges distinct, loops gone."""
    owners = files.groupBy("file").agg(F.min_by("owner", F.when(F.col("owner").isNotNull(), F.col("sidecar"))).alias("owner"), (F.count_distinct("owner") > 1).alias("conflict"))
    return owners, edges.where("src <> dst").select("src", "dst").distinct()


def owner_of(paths: DataFrame, owners: DataFrame) -> DataFrame:
    """Owner of each path: an exact file (tier 0), else the longest source directory (tier 1).

    ``owners`` has ``key, owner, exact``. Paths are exploded into themselves and their ancestors.
    """
    cut = F.split("path", "/")
    keys = paths.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(cut)), lambda k: F.array_join(F.slice(cut, 1, k), "/"))).alias("key"))
    hits = keys.join(owners, "key").where((~F.col("exact")) | (F.col("key") == F.col("path")))
    rank = F.struct(F.when(F.col("exact"), 0).otherwise(1), -F.length("key"), "owner")
    return hits.groupBy("path").agg(F.min_by("owner", rank).alias("owner"))




def hosted_services(path: str, text: str) -> Iterator[tuple]:
    """``path, service`` of the background services that a host program registers."""
    for name in dict.fromkeys(re.findall(r"AddHostedService\s*<\s*(?:[\w.]+\.)?(\w+)\s*>", blank_comments(text))):
        yield path, name


#: Names of test files, and what a call in them looks like: a receiver, a dot, a method, a parenthesis.
TESTS = "*{Test,_test}*.{cs,cpp}"
_CALL = re.compile(r"([A-Za-z_]\w*)\s*\.\s*([A-Za-z_]\w*)\s*\(")
CALLS = "path string, position int, receiver string, method string"


def test_calls(path: str, text: str) -> Iterator[tuple]:
    """``path, position, receiver, method`` of the calls of a test file, in their order."""
    name = posixpath.basename(path)
    if name.endswith(".cs") and "Test" in name or name.endswith("_test.cpp"):
        for m in _CALL.finditer(text):
            yield path, m.start(), m[1], m[2]


test_calls.__test__ = False


def service_hosts(found: DataFrame) -> DataFrame:
    """Host of each background service: the first of those that register it, by path."""
    return found.groupBy("service").agg(F.min("path").alias("host"))


def artifact_kind(path: Column) -> Column:
    """What a file of a tree is to a reader of architecture; null for any other."""
    low = F.lower(path)
    return (
        F.when(low.rlike(r"(^|/)(adr|adrs|decisions)/.*\.md$"), "decision")
        .when(low.endswith(".dsl"), "model")
        .when(low.rlike(r"\.(puml|plantuml|mmd)$"), "diagram")
        .when(low.rlike(r"(^|/)(dockerfile|docker-compose.*\.ya?ml|chart\.yaml)$"), "deployment")
        .when(low.rlike(r"\.(sln|slnx|csproj|vcxproj)$|(^|/)(cmakelists\.txt|makefile\.(am|in))$"), "build")
    )


def overlaid(nodes: DataFrame, edges: DataFrame, graph_nodes: DataFrame, graph_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A build model with what only the drawn graph has: its further nodes, and its edges in place of the model's, if any."""
    further = graph_nodes.join(nodes.select("id"), "id", "left_anti")
    drawn = graph_edges.join(nodes.select("id").union(graph_nodes.select("id")).distinct().withColumnRenamed("id", "source"), "source", "left_semi")
    return nodes.unionByName(further, allowMissingColumns=True), edges if drawn.isEmpty() else drawn
