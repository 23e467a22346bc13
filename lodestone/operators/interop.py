"""Resolving language boundaries: native libraries, managed assemblies and COM identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodestone.functions.identifiers import is_guid, norm_guid, norm_lib
from lodestone.operators.merge import merge_evidence


def _library(name):
    return F.regexp_replace(norm_lib(name), r"\.(dll|so|dylib)$", "")


def resolve_native(boundaries: DataFrame, targets: DataFrame) -> DataFrame:
    """``boundary, target`` by library name: the only shared library of the name, else the only candidate."""
    shared = F.when(F.col("type") == "shared_lib", F.col("id"))
    # One row a name: a boundary never meets the candidates one by one.
    named = targets.groupBy(_library(F.col("name")).alias("k")).agg(F.count(shared).alias("n_shared"), F.min(shared).alias("shared"), F.count("*").alias("n"), F.min("id").alias("only"))
    hits = boundaries.select(F.col("id").alias("boundary"), _library(F.col("name")).alias("k")).join(named, "k")
    found = hits.groupBy("boundary").agg(F.sum("n_shared").alias("n_shared"), F.min("shared").alias("shared"), F.sum("n").alias("n"), F.min("only").alias("only"))
    chosen = F.when(F.col("n_shared") == 1, F.col("shared")).when(F.col("n") == 1, F.col("only"))
    return found.select("boundary", chosen.alias("target")).where("target IS NOT NULL")


def resolve_managed(boundaries: DataFrame, targets: DataFrame) -> DataFrame:
    """``boundary, target`` by assembly name, where only one target has it."""
    named = targets.groupBy(F.lower("name").alias("k")).agg(F.count("*").alias("n"), F.min("id").alias("target"))
    hits = boundaries.select(F.col("id").alias("boundary"), F.lower("name").alias("k")).join(named, "k")
    return hits.groupBy("boundary").agg(F.sum("n").alias("n"), F.min("target").alias("target")).where("n = 1").drop("n")


def resolve_com(boundaries: DataFrame, targets: DataFrame) -> DataFrame:
    """``boundary, target`` by class id, exactly, or program id, without case; unique only."""
    key = lambda c: F.when(is_guid(F.regexp_replace(c, "[{}]", "")), norm_guid(c)).otherwise(F.lower(c))
    provided = targets.select("id", F.explode("com_provides").alias("p")).groupBy(key(F.col("p")).alias("k")).agg(F.min("id").alias("low"), F.max("id").alias("high"))
    hits = boundaries.select(F.col("id").alias("boundary"), key(F.col("name")).alias("k")).join(provided, "k")
    # The least and the greatest target are the same only where there is one.
    return hits.groupBy("boundary").agg(F.min("low").alias("target"), F.max("high").alias("high")).where("target = high").drop("high")


def rewrite(items: DataFrame, targets: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Targets without the resolved boundaries, and evidence items that point at what they stand for."""
    kept = targets.join(resolved.select(F.col("boundary").alias("id")), "id", "left_anti")
    out = items
    for end in ("source", "target"):
        out = out.join(resolved.select(F.col("boundary").alias("_b"), F.col("target").alias("_t")), F.col(end) == F.col("_b"), "left").withColumn(end, F.coalesce("_t", end)).drop("_b", "_t")
    return kept, merge_evidence(out.where("source <> target"))


def rebind_directories(items: DataFrame, owners: DataFrame) -> DataFrame:
    """Items whose source is ``dir:<path>`` moved to the target with the longest path above it; others go.

    ``owners`` has ``id, path``. Each directory is exploded into its ancestors for an equi-join.
    """
    directory = F.substring("source", 5, 10**6)
    cut = F.split(directory, "/")
    loose = items.where(F.col("source").startswith("dir:"))
    above = loose.select("source", F.explode(F.transform(F.sequence(F.lit(1), F.size(cut)), lambda k: F.array_join(F.slice(cut, 1, k), "/"))).alias("path")).distinct()
    found = above.join(owners, "path").groupBy("source").agg(F.max_by("id", F.struct(F.length("path"), "id")).alias("_id"))
    moved = loose.join(found, "source").withColumn("source", F.col("_id")).drop("_id")
    return merge_evidence(items.where(~F.col("source").startswith("dir:")).unionByName(moved))
