"""Grouping proposals by tags, directories and clusters, in order of trust."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodestone.operators.components import connected_components
from lodestone.operators.graph import LOCAL
from lodestone.session import materialise

LEAST = 2


def by_tag(targets: DataFrame, prefix: str) -> DataFrame:
    """Groups of targets that share a tag of the prefix: ``name, id``."""
    tagged = targets.select("id", F.explode("tags").alias("tag")).where(F.col("tag").startswith(prefix)).select("id", F.substring("tag", len(prefix) + 1, 10**6).alias("name"))
    return _large(tagged)


def _large(pairs: DataFrame) -> DataFrame:
    sizes = pairs.groupBy("name").agg(F.count_distinct("id").alias("n")).where(F.col("n") >= LEAST)
    return pairs.join(sizes.select("name"), "name", "left_semi").select("name", "id").distinct()


def by_directory(targets: DataFrame) -> DataFrame:
    """Groups by the first two path segments, then by the first for the rest."""
    cut = F.split("path", "/")
    two = _large(targets.where(F.size(cut) > 2).select("id", F.array_join(F.slice(cut, 1, 2), "/").alias("name")))
    rest = targets.join(two.select("id"), "id", "left_anti")
    return two.unionByName(_large(rest.where(F.size(cut) > 1).select("id", cut[0].alias("name"))))


def by_namespace(targets: DataFrame) -> DataFrame:
    """Groups by the root of the first namespace in order; targets without one take no part."""
    root = F.element_at(F.split(F.array_min("namespaces"), r"::|\."), 1)
    return _large(targets.where(F.size("namespaces") > 0).select("id", root.alias("name")))


def by_cluster(targets: DataFrame, edges: DataFrame) -> DataFrame:
    """Groups by weakly connected component, named by their smallest member."""
    first = targets.where("NOT external").select("id")
    inner = edges.join(first, F.col("source") == F.col("id"), "left_semi").join(first, F.col("target") == F.col("id"), "left_semi")
    return _large(connected_components(inner, "source", "target", local=LOCAL).select(F.col("component").alias("name"), F.col("node").alias("id")))


def proposal(targets: DataFrame, edges: DataFrame, prefixes: tuple[str, ...] = ("module-category:", "plugin-type:", "slnfolder:")) -> DataFrame:
    """``signal, name, id``: each signal takes only what those before it left, and again two members at least."""
    namespaces = F.col("namespaces") if "namespaces" in targets.columns else F.array().cast("array<string>")
    free = materialise(targets.where("NOT external").select("id", "path", "tags", "external", namespaces.alias("namespaces")), "free")
    out = None
    signals = [(p.rstrip(":"), lambda t, p=p: by_tag(t, p)) for p in prefixes] + [("directory", by_directory), ("namespace", by_namespace), ("cluster", lambda t: by_cluster(t, edges))]
    for signal, find in signals:
        found = materialise(find(free).withColumn("signal", F.lit(signal)).select("signal", "name", "id"), "claimed")
        out = found if out is None else out.unionByName(found)
        free = free.join(found.select("id"), "id", "left_anti")
    return out
