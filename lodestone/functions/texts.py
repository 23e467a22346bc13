"""Text measures and redaction, as expressions where Spark has them and Arrow functions where not."""

from __future__ import annotations

import difflib
import hashlib
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

# Line and block comment marks by language family, and languages by extension.
COMMENTS = {"c": ("//", "/*", "*/"), "python": ("#", '"""', '"""'), "xml": (None, "<!--", "-->"), "shell": ("#", None, None)}
LANGUAGE = {"c": "C", "h": "C/C++ Header", "cc": "C++", "cpp": "C++", "cxx": "C++", "hpp": "C++ Header", "cs": "C#", "py": "Python", "sh": "Shell", "xml": "XML", "json": "JSON", "md": "Markdown", "yaml": "YAML", "yml": "YAML", "html": "HTML", "js": "JavaScript", "ts": "TypeScript", "java": "Java", "go": "Go", "rs": "Rust", "sql": "SQL"}
NAMED = {"cmakelists.txt": "CMake", "makefile": "Makefile", "dockerfile": "Dockerfile"}


def language_of(filename: Column) -> Column:
    """Language by exact name, then by lower-cased extension; null where neither is known."""
    table = lambda d: F.create_map(*(F.lit(x) for pair in d.items() for x in pair))
    name = F.lower(F.element_at(F.split(filename, "/"), -1))
    return F.coalesce(table(NAMED)[name], table(LANGUAGE)[F.regexp_extract(name, r"\.([^.]+)$", 1)])


def count_lines(text: str, family: str) -> dict[str, int]:
    """Blank, comment, code and TODO lines; a line with code beside a comment is code."""
    line_mark, start, end = COMMENTS[family]
    out = {"blank": 0, "comment": 0, "code": 0, "todo": 0}
    inside = False
    for line in text.splitlines():
        out["todo"] += "TODO" in line or "FIXME" in line
        rest, code, comment = line.strip(), False, inside
        if not rest:
            out["blank"] += 1
            continue
        while rest:
            if inside:
                cut = rest.find(end)
                inside = cut < 0
                rest = "" if inside else rest[cut + len(end) :].strip()
                comment = True
            elif line_mark and rest.startswith(line_mark):
                comment, rest = True, ""
            elif start and rest.startswith(start):
                comment, inside, rest = True, True, rest[len(start) :]
            else:
                code = True
                marks = [k for k in (rest.find(m) for m in (line_mark, start) if m) if k >= 0]
                rest = rest[min(marks) :] if marks else ""
        out["code" if code else "comment"] += bool(code or comment)
    return out


#: Line ends, as text mode reads them.
_LINE_END = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"


def line_counts(text: Column, family: str) -> Column:
    """``blank, comment, code, todo`` of a text as ``count_lines`` counts them, by a fold over its lines.

    A line that begins inside a comment is read as if the comment's mark stood before it. Whole
    comments go; a mark that is left opens one that goes on; what stands before it is code.
    """
    line_mark, start, end = COMMENTS[family]
    quote = lambda mark: re.escape(mark).replace("/", r"\/")
    whole = [f"{quote(line_mark)}.*$"] if line_mark else []
    whole += [f"{quote(start)}.*?{quote(end)}"] if start else []
    marks = "|".join(quote(m) for m in (line_mark, start) if m)
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    lines = F.split(F.coalesce(text, F.lit("")), _LINE_END)
    # A line end closes a line and opens none after the last.
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    zero = F.struct(F.lit(False).alias("inside"), *(F.lit(0).cast("long").alias(n) for n in ("blank", "comment", "code", "todo")))

    def step(state: Column, line: Column) -> Column:
        blank = strip(line) == ""
        opened = F.when(state["inside"], F.concat(F.lit(start or ""), line)).otherwise(line)
        rest = F.regexp_replace(opened, "|".join(whole), " ")
        open_ = rest.contains(start) if start else F.lit(False)
        code = strip(F.substring_index(rest, start, 1) if start else rest) != ""
        comment = state["inside"] | opened.rlike(marks)
        one = lambda c: c.cast("long")
        return F.struct(
            F.when(blank, state["inside"]).otherwise(open_).alias("inside"), (state["blank"] + one(blank)).alias("blank"), (state["comment"] + one(~blank & ~code & comment)).alias("comment"),
            (state["code"] + one(~blank & code)).alias("code"), (state["todo"] + one(line.contains("TODO") | line.contains("FIXME"))).alias("todo"),
        )

    return F.aggregate(lines, zero, step, lambda s: F.struct(*(s[n].alias(n) for n in ("blank", "comment", "code", "todo"))))


def name_similarity(a: Column, b: Column) -> Column:
    """Ratio of matching blocks of two lower-cased names; edit distance gives other values."""

    @pandas_udf("double")
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x.lower(), y.lower()).ratio() if x and y else 0.0 for x, y in zip(left, right)], dtype=float)

    return run(a, b)


def redact(text: Column, patterns: list[str], denied: list[str], cap: int | None = None) -> Column:
    out = text
    for pattern in patterns:
        out = F.regexp_replace(out, pattern, "[redacted]")
    for word in denied:
        out = F.replace(out, F.lit(word), F.lit("[redacted]"))
    return F.left(out, F.lit(cap)) if cap else out


def has_text(*fields: Column) -> Column:
    """Whether any text, or any entry of a list of texts, is more than white space."""
    blank = lambda c: F.coalesce(F.trim(F.regexp_replace(c, r"\s+", " ")) == "", F.lit(True))
    found = F.lit(False)
    for one in fields:
        found = found | F.coalesce(F.exists(one, lambda t: ~blank(t)), F.lit(False))
    return found


def canonical_json(value) -> str:
    """Sorted keys, two spaces, plain Unicode, and a line end."""
    return json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False) + "\n"


# List fields of a target whose order means nothing, and what differs between runs of one model.
SET_FIELDS = ("namespaces", "depends_on", "responsibilities", "com_provides", "tags")
VOLATILE = ("generated_at", "commit", "interop_resolved")


def canonical(model: dict) -> dict:
    """A model with its targets, relationships, evidence and set-like lists in order."""
    def sorted_lists(record: dict, fields: tuple[str, ...]) -> dict:
        return record | {f: sorted(record[f]) for f in fields if isinstance(record.get(f), list)}

    def of_edge(edge: dict) -> dict:
        evidence = edge.get("evidence")
        return edge | {"evidence": sorted(evidence, key=lambda e: (e.get("type", ""), e.get("detail", "")))} if isinstance(evidence, list) else edge

    targets = sorted((sorted_lists(t, SET_FIELDS) for t in model.get("targets", [])), key=lambda t: t.get("id", ""))
    edges = sorted(map(of_edge, model.get("relationships", [])), key=lambda e: (e.get("source", ""), e.get("target", "")))
    return model | {"targets": targets, "relationships": edges}


def without_volatile(model: dict) -> dict:
    """The canonical model without the provenance that differs between runs."""
    kept = {k: v for k, v in model.get("provenance", {}).items() if k not in VOLATILE}
    return canonical(model) | {"provenance": kept}


def content_hash(model: dict) -> str:
    """Hash of a model's canonical text, whatever the order of its parts and the run that made it."""
    return hashlib.sha256(canonical_json(without_volatile(model)).encode()).hexdigest()


def _words(text: Column) -> Column:
    """Words of letters and digits of the last part of a path; a project file's ending is none."""
    last = F.element_at(F.split(F.replace(text, F.lit("\\"), F.lit("/")), "/"), -1)
    return F.filter(F.split(F.regexp_replace(last, r"(?i)\.csproj$", ""), "[^0-9A-Za-z]+"), lambda w: w != "")


def element_name(element_id: Column) -> Column:
    """Name of an element in a diagram: the words of its repository and of its key in one, only the first in lower case.

    The key is the last part of the id that is not empty; one without words gives way to the id's own, or to
    ``e``. A name that would begin with a digit has ``e`` before it. Names may be equal, see ``unique_names``.
    """
    cut = F.split(element_id, "::")
    bare = F.element_at(cut, -1)
    key = F.coalesce(F.try_element_at(F.filter(F.split(bare, ":"), lambda part: part != ""), F.lit(-1)), bare)
    first = lambda *choices: F.coalesce(*(F.when(F.size(c) > 0, c) for c in choices))
    none = F.array().cast("array<string>")
    repository = F.when(F.size(cut) > 1, _words(F.array_join(F.slice(cut, F.lit(1), F.size(cut) - 1), "::"))).otherwise(none)
    words = F.concat(repository, first(_words(key), _words(bare), F.array(F.lit("e"))))
    head = lambda w, k: F.when(k == 0, F.lower(F.left(w, F.lit(1)))).otherwise(F.upper(F.left(w, F.lit(1))))
    name = F.array_join(F.transform(words, lambda w, k: F.concat(head(w, k), F.substr(w, F.lit(2)))), "")
    return F.when(name.rlike("^[A-Za-z]"), name).otherwise(F.concat(F.lit("e"), name))


def unique_names(rows: DataFrame, id_col: str = "id") -> DataFrame:
    """``id, name`` of each distinct id, names unequal without regard to case: of equal ones the smallest id keeps its own, others take a hash of the id."""
    named = rows.select(F.col(id_col).alias("id")).where("id IS NOT NULL").distinct().withColumn("_name", element_name(F.col("id")))
    first = named.groupBy(F.lower("_name").alias("_low")).agg(F.min("id").alias("_first"))
    joined = named.join(first, F.lower("_name") == F.col("_low"))
    return joined.select("id", F.when(F.col("id") == F.col("_first"), F.col("_name")).otherwise(F.concat("_name", F.lit("_"), F.left(F.sha1("id"), F.lit(6)))).alias("name"))


# Words that name a primitive, the first that a question holds counts, and those by which dependents are asked for.
ROUTES = (
    ("blast_radius", ("blast", "impact")),
    ("cycles_of", ("cycle",)),
    ("conformance_of", ("allowed", "forbidden", "violat", "conform")),
    ("paths_between", ("path", "reach")),
    ("explain_of", ("why", "explain")),
)
DEPENDENTS, ASKERS = ("dependents", "depended"), ("what", "who", "which")


def _asks_dependents(words: list[str]) -> bool:
    """A question for dependents names them, or has its question word, or "which" and a noun, right before "depends"."""
    subjects = [words[max(0, k - 2) : k] for k, word in enumerate(words) if word == "depends"]
    return any(w in DEPENDENTS for w in words) or any(s[-1:] and (s[-1] in ASKERS or s[0] == "which") for s in subjects)


def question_route(question: str) -> str | None:
    """Primitive of a question by its words; "if ... change" asks for the blast radius before all others."""
    low = question.lower()
    if "if" in low and "change" in low:
        return "blast_radius"
    named = [primitive for primitive, words in ROUTES if any(map(low.__contains__, words))]
    if named:
        return named[0]
    if "depend" not in low:
        return None
    return "dependents" if _asks_dependents(re.findall(r"\w+", low)) else "dependencies"
