"""Source trees as a table of files, and parsers applied to it file by file."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Directories that hold products or history, not sources.
SKIPPED = ("bin", "obj", ".git", "node_modules")


def source_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """``path, text`` of the files under ``root`` whose name fits the shell pattern; any file system. Spark lists no file of zero bytes."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    place = root.rstrip("/").split("://")[-1].removeprefix("file:")
    path = F.regexp_replace(F.col("path"), r"^[a-z]+:/*", "/")
    relative = F.regexp_replace(F.substring_index(path, place.rstrip("/") + "/", -1), "^/+", "")
    # A leading byte-order mark is no text; invalid bytes become replacement characters.
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")
    skipped = F.arrays_overlap(F.split(F.lower(relative), "/"), F.array(*map(F.lit, SKIPPED)))
    return found.select(relative.alias("path"), text.alias("text")).where(~skipped)


#: What a reader raises on a file that it can't read.
UNREADABLE = (ValueError, KeyError, TypeError, AttributeError, SyntaxError, yaml.YAMLError)


def parsed(files: DataFrame, parse: Callable[[str, str], Iterator[tuple] | list[tuple]], schema: str) -> DataFrame:
    """Rows that ``parse(path, text)`` yields for each file; a file it can't read gives none here and one in ``unread``."""
    columns = [part.strip().split()[0] for part in _split_schema(schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for path, text in zip(batch["path"], batch["text"]):
                try:
                    rows += list(parse(path, text or ""))
                except UNREADABLE:
                    continue
            yield pd.DataFrame(rows, columns=columns)

    return files.mapInPandas(run, schema)


def unread(files: DataFrame, parse: Callable[[str, str], Iterator[tuple] | list[tuple]]) -> DataFrame:
    """``path, reader, error`` of the files that ``parse`` can't read."""
    reader = getattr(parse, "__name__", "reader")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for path, text in zip(batch["path"], batch["text"]):
                try:
                    for _ in parse(path, text or ""):
                        pass
                except UNREADABLE as error:
                    rows.append((path, reader, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["path", "reader", "error"], dtype=object)

    return files.mapInPandas(run, "path string, reader string, error string")


def _split_schema(schema: str) -> list[str]:
    parts, depth, start = [], 0, 0
    for k, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(schema[start:k])
            start = k + 1
    return [*parts, schema[start:]]


def nearest_ancestor(files: DataFrame, projects: DataFrame) -> DataFrame:
    """Each file with the project in the nearest directory above it; ties go to the smaller path."""
    def directory(path):
        return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")

    cut = F.split(directory(F.col("path")), "/")
    above = F.array_union(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(cut)), lambda k: F.array_join(F.slice(cut, 1, k), "/")))
    owned = projects.select(F.col("path").alias("project"), directory(F.col("path")).alias("_dir"))
    joined = files.select("path", F.explode(F.array_distinct(above)).alias("_dir")).join(owned, "_dir")
    best = F.struct((-F.length("_dir")).alias("depth"), "project")
    return joined.groupBy("path").agg(F.min(best).alias("best")).select("path", F.col("best.project").alias("project"))
