"""Expressions over element identifiers ``[repo::]namespace:kind:key``, names and paths."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column, functions as F


def has_repo(id_: Column) -> Column:
    return id_.contains("::")


def repo_of(id_: Column) -> Column:
    return F.when(has_repo(id_), F.split_part(id_, F.lit("::"), F.lit(1)))


def strip_repo(id_: Column) -> Column:
    return F.regexp_replace(id_, "^.*?::", "")


def with_repo(repo: str, id_: Column) -> Column:
    return F.when(has_repo(id_), id_).otherwise(F.concat(F.lit(repo + "::"), id_))


def parts(id_: Column) -> Column:
    """namespace, kind and key; the key keeps further colons."""
    cut = F.split(strip_repo(id_), ":", 3)
    return F.struct(cut[0].alias("namespace"), F.coalesce(F.get(cut, F.lit(1)), F.lit("")).alias("kind"), F.coalesce(F.get(cut, F.lit(2)), F.lit("")).alias("key"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def camel(key: Column) -> Column:
    """lowerCamel token of the alphanumeric runs of a base name."""
    runs = F.filter(F.split(basename(key), "[^0-9A-Za-z]+"), lambda w: w != "")
    joined = F.array_join(F.transform(runs, lambda w, i: F.when(i == 0, F.concat(F.lower(F.substring(w, 1, 1)), F.substring(w, 2, 10**6))).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 10**6)))), "")
    return joined


def rel_id(source: Column, target: Column) -> Column:
    return F.concat(F.lit("rel:"), source, F.lit("->"), target)


def glob_regex(pattern: str) -> str:
    """Regular expression of a case-sensitive shell pattern: ``*`` also crosses ``/``; whole-string match."""
    body = fnmatch.translate(pattern)
    return re.sub(r"^\(\?s:(.*)\)\\[zZ]$", r"(?s)^(?:\1)$", body).replace("(?>", "(?:")


def glob(column: Column, pattern: str) -> Column:
    return F.coalesce(column.rlike(glob_regex(pattern)), F.lit(False))


def norm_slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^0-9a-z]", "")


def path_tokens(text: Column) -> Column:
    """Distinct lower-case tokens, without single characters and plain numbers."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^0-9a-z]+"), lambda t: (F.length(t) > 1) & ~t.rlike(r"^\d+$")))


def convention(name: Column) -> Column:
    return F.when(name.contains(" "), "spaced").when(name.contains("_"), "snake").when(name.rlike("^[A-Za-z]*[a-z][A-Z]"), "camel").otherwise("other")


def is_guid(value: Column) -> Column:
    return value.rlike("^[0-9A-Fa-f]+(-[0-9A-Fa-f]+){4}$")


def norm_guid(value: Column) -> Column:
    return F.lower(F.regexp_replace(value, "^[{}]+|[{}]+$", ""))


def norm_lib(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.startswith("lib"), F.substring(low, 4, 10**6)).otherwise(low)
