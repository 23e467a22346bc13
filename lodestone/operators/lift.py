"""Lifting target-level facts to containers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def cross_edges(edges: DataFrame, targets: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Edges with the containers of both ends; those within one container are dropped.

    Here and below, with ``by`` the tables hold many models, told apart by these columns.
    """
    return _lifted(edges, targets, by).where("source_container <> target_container")


def _lifted(edges: DataFrame, targets: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    out = edges
    for end in ("source", "target"):
        out = out.join(targets.select(*by, F.col("id").alias(end), F.col("container_id").alias(f"{end}_container")), [*by, end])
    return out


def container_edges(edges: DataFrame, targets: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Weights summed, declaration by or, number of edges and the strongest confidence of each container pair."""
    rank = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "medium", 1).otherwise(2)
    return cross_edges(edges, targets, by).groupBy(*by, "source_container", "target_container").agg(
        F.sum("weight").alias("weight"), F.bool_or("is_declared_dependency").alias("is_declared"), F.count("*").alias("n_edges"), F.min_by("confidence", rank).alias("confidence")
    )


def containers(targets: DataFrame) -> DataFrame:
    """Members, tags and the boundary mark (all members external) of each container."""
    return targets.groupBy("container_id").agg(
        F.count("*").alias("members"), F.bool_and("external").alias("boundary"), F.min("id").alias("first_member"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))), ",").alias("tags")
    )


def half_edges(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges as seen from their containers: inner ones once, outer ones once from each side."""
    lifted = _lifted(edges, targets)
    inner = lifted.where("source_container = target_container").select(F.col("source_container").alias("container_id"), "source", "target", F.lit("inner").alias("side"), "weight")
    outer = lifted.where("source_container <> target_container")
    sides = F.explode(F.array(F.struct(F.col("source_container").alias("container_id"), F.lit("out").alias("side")), F.struct(F.col("target_container").alias("container_id"), F.lit("in").alias("side"))))
    return inner.unionByName(outer.select("source", "target", "weight", sides.alias("x")).select("x.container_id", "source", "target", "x.side", "weight"))


def degree(edges: DataFrame, by: tuple[str, ...] = (), rows: int = 0) -> DataFrame:
    """Distinct neighbours and weights of each node of ``source_container -> target_container`` pairs.

    With ``rows``, the number of ``edges``, no task holds more than about half a million ends of edges.
    """
    kind = dict(edges.dtypes)["source_container"]
    both = F.explode(F.array(
        F.struct(F.col("source_container").alias("node"), F.col("target_container").alias("out"), F.lit(None).cast(kind).alias("into"), F.col("weight").alias("w")),
        F.struct(F.col("target_container").alias("node"), F.lit(None).cast(kind).alias("out"), F.col("source_container").alias("into"), F.col("weight").alias("w")),
    ))
    ends = edges.select(*by, both.alias("x")).select(*by, "x.*")
    ends = ends.withColumn("near", F.coalesce("out", "into"))
    if rows:
        ends = ends.repartition(rows // 250_000 + 1, *by, "node", "near")
    # A neighbour is one row first, then counted.
    pairs = ends.groupBy(*by, "node", "near").agg(F.count("out").alias("outs"), F.count("into").alias("ins"), F.sum("w").alias("w"))
    return pairs.groupBy(*by, "node").agg(F.sum("outs").alias("efferent"), F.sum("ins").alias("afferent"), F.count("near").alias("neighbours"), F.sum("w").alias("weight"))


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ``ids``: the sub-graph of an answer."""
    own = ids.select(F.col("id").alias("_id")).distinct()
    return edges.join(own, F.col("source") == F.col("_id"), "left_semi").join(own, F.col("target") == F.col("_id"), "left_semi")


def drilldown(edges: DataFrame, targets: DataFrame, container_id: str) -> DataFrame:
    """Edges of a container's members: inner ones, and one for each member and neighbour container with the weight of all."""
    seen = half_edges(edges, targets).where(F.col("container_id") == container_id)
    inner = seen.where("side = 'inner'").select("source", "target", "weight")
    other = targets.select(F.col("id").alias("_id"), F.col("container_id").alias("_other"))
    out = seen.where("side = 'out'").join(other, F.col("target") == F.col("_id")).groupBy("source", F.col("_other").alias("target")).agg(F.sum("weight").alias("weight"))
    into = seen.where("side = 'in'").join(other, F.col("source") == F.col("_id")).groupBy(F.col("_other").alias("source"), "target").agg(F.sum("weight").alias("weight"))
    return inner.unionByName(out).unionByName(into)


def unique_labels(targets: DataFrame) -> DataFrame:
    """``label, container_id`` of normalised names that mean one container only."""
    key = F.regexp_replace(F.lower(F.col("name")), "[^0-9a-z]", "")
    return targets.select(key.alias("label"), "container_id").groupBy("label").agg(F.count_distinct("container_id").alias("n"), F.min("container_id").alias("container_id")).where("n = 1").drop("n")
