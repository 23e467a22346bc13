"""Side files of extractors: restore results, compile commands, file dependencies and type lists."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from lodestone.sources.rsf import quoted

PACKAGES = "path string, project string, package string"
COMMANDS = "path string, directory string, file string, command string"
FILE_DEPS = "path string, kind string, a string, b string"
API_TYPES = "path string, target string, types array<string>"


def restored_packages(path: str, text: str) -> Iterator[tuple]:
    """Package names of a restore result, direct and transitive, over all frameworks; of another shape none."""
    data = json.loads(text)
    frameworks = data.get("targets") if isinstance(data, dict) else None
    names = set()
    for found in frameworks.values() if isinstance(frameworks, dict) else ():
        if isinstance(found, dict):
            names.update(key.partition("/")[0] for key, body in found.items() if isinstance(body, dict) and body.get("type") == "package")
    project = path.rpartition("/obj/")[0]
    yield from ((path, project, name) for name in sorted(names))


def with_packages(projects: DataFrame, packages: DataFrame) -> DataFrame:
    """``project, packages, covered``: a project without a restore result has none, and its layer is not covered."""
    found = packages.groupBy("project").agg(F.array_sort(F.collect_set("package")).alias("packages"))
    return projects.select("project").join(found, "project", "left").withColumn("covered", F.col("packages").isNotNull())


def compile_commands(projects: DataFrame) -> DataFrame:
    """``directory, file, command`` of every source: the compiler call that its project's settings make.

    ``projects`` has ``directory, sources, includes, defines``. Approximate, as settings of sheets and
    configurations are not evaluated.
    """
    flags = F.concat(F.transform("includes", lambda x: F.concat(F.lit("/I"), x)), F.transform("defines", lambda x: F.concat(F.lit("/D"), x)))
    rows = projects.select("directory", flags.alias("flags"), F.explode("sources").alias("file"))
    return rows.select("directory", "file", F.array_join(F.concat(F.array(F.lit("cl.exe")), "flags", F.array(F.lit("/c"), F.col("file"))), " ").alias("command"))


def file_dependencies(path: str, text: str) -> Iterator[tuple]:
    """Owners (``file``: file, target) and edges (``edge``: from, to) of the file block of a fragment."""
    block = json.loads(text).get("fileDeps") or {}
    yield from ((path, "file", name, target) for name, target in sorted((block.get("files") or {}).items()))
    yield from ((path, "edge", edge[0], edge[1]) for edge in block.get("edges") or [] if len(edge) == 2)


def api_types(path: str, text: str) -> Iterator[tuple]:
    """Public types of each target of the type block of a fragment."""
    block = json.loads(text).get("apiSkeleton") or {}
    yield from ((path, target, list(types)) for target, types in sorted((block.get("targets") or {}).items()))


def merged_types(rows: DataFrame) -> DataFrame:
    """``target, types``: the list of the first side file by name; lists are not united."""
    return rows.groupBy("target").agg(F.min_by("types", "path").alias("types"))


def file_contain_lines(files: DataFrame, targets: DataFrame, include_external: bool = False) -> tuple[DataFrame, DataFrame]:
    """``contain`` lines of files by their target's container, and one row of what was left out.

    ``files`` has ``file, target``: files without a target are unattributed, those whose target is not
    in the curated model uncurated.
    """
    kept = targets if include_external else targets.where("NOT external")
    placed = files.join(kept.select(F.col("id").alias("target"), F.coalesce("container_id", "id").alias("container_id")), "target", "left")
    lines = placed.where("container_id IS NOT NULL").select(F.concat_ws(" ", F.lit("contain"), quoted(F.col("container_id")), quoted(F.col("file"))).alias("line")).distinct()
    counts = placed.agg(F.count_if(F.col("target").isNull()).alias("unattributed"), F.count_if(F.col("target").isNotNull() & F.col("container_id").isNull()).alias("uncurated"))
    return lines, counts
