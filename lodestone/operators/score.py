"""Confidence of elements and containers, strata, and the risk-coverage curve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestone.functions import evidence as ev
from lodestone.operators.ranking import before

# Base score by strongest layer; bonuses, cap and threshold.
BASE = {"L0": 0.60, "L1": 0.48, "L2": 0.40, "L3": 0.40, "interop": 0.50, "runtime": 0.38, "none": 0.10}
ORDER = ("L0", "interop", "L1", "L2", "L3", "runtime")
CORROBORATION, BONUS, CAP, THRESHOLD, K = 0.25, 0.10, 0.49, 0.50, 2


def incident(edges: DataFrame) -> DataFrame:
    """Edges as seen from both ends: ``id, n_items, layers, high``."""
    seen = edges.select(F.explode(F.array("source", "target")).alias("id"), F.size("evidence").cast("long").alias("n_items"), ev.layers(F.col("evidence")).alias("layers"), (F.col("confidence") == "high").alias("high"))
    return seen


def element_scores(targets: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, stratum, score``: strongest incident layer, corroboration, several layers, a high edge, documentation."""
    rank = lambda x: F.array_position(F.array(*map(F.lit, ORDER)), x)
    near = incident(edges).groupBy("id").agg(
        F.sum("n_items").alias("n"), F.min(F.array_min(F.transform("layers", rank))).alias("best"), F.bool_or("high").alias("high"), F.array_distinct(F.flatten(F.collect_set("layers"))).alias("layers")
    )
    joined = targets.join(near, "id", "left")
    stratum = F.coalesce(F.get(F.array(*map(F.lit, ORDER)), (F.col("best") - 1).cast("int")), F.lit("none"))
    base = F.create_map(*(F.lit(x) for pair in BASE.items() for x in pair))[stratum]
    flag = lambda c: F.when(F.coalesce(c, F.lit(False)), BONUS).otherwise(0.0)
    total = base + F.least(F.lit(1.0), F.coalesce("n", F.lit(0)) / (2.0 * K)) * CORROBORATION + flag(F.size("layers") >= 2) + flag(F.col("high")) + flag(F.col("documented"))
    capped = F.when(F.array_contains("tags", "needs-curation"), F.least(F.lit(CAP), total)).otherwise(total)
    return joined.select("id", "container_id", stratum.alias("stratum"), F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), capped)), 4).alias("score"))


def band(score: Column) -> Column:
    return F.when(score >= 0.70, "high").when(score >= 0.50, "medium").otherwise("low")


def container_scores(scores: DataFrame) -> DataFrame:
    return scores.groupBy("container_id").agg(
        F.count("*").alias("members"), F.bround(F.avg("score"), 4).alias("mean"), F.min("score").alias("lowest"), F.max("score").alias("highest"), F.count_if(F.col("score") < THRESHOLD).alias("abstained")
    )


def strata(scores: DataFrame) -> DataFrame:
    """Elements, abstentions and mean per stratum, and in all."""
    grouped = scores.rollup("stratum").agg(F.count("*").alias("elements"), F.count_if(F.col("score") < THRESHOLD).alias("abstained"), F.bround(F.avg("score"), 4).alias("mean"))
    return grouped.withColumn("stratum", F.coalesce("stratum", F.lit("total")))


def risk_curve(scores: DataFrame) -> DataFrame:
    """At each distinct score as threshold: retained, coverage, and mean of 1 - score of the retained.

    Scores are counted before the window, so that it runs over distinct values.
    """
    by = scores.groupBy("score").agg(F.count("*").alias("n"), F.sum(1 - F.col("score")).alias("r"))
    down = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return by.select(F.col("score").alias("threshold"), F.sum("n").over(down).alias("retained"), F.round(F.sum("n").over(down) / F.sum("n").over(every), 6).alias("coverage"), F.round(F.sum("r").over(down) / F.sum("n").over(down), 6).alias("risk"))


def aurc(curve: DataFrame) -> DataFrame:
    """Area under the curve by trapezoids over the coverage; 0 with fewer than two points."""
    order = Window.orderBy("coverage")
    width = F.col("coverage") - F.lag("coverage").over(order)
    height = (F.col("risk") + F.lag("risk").over(order)) / 2
    return curve.select((width * height).alias("a")).agg(F.round(F.coalesce(F.sum("a"), F.lit(0.0)), 6).alias("aurc"))


def size_bands(scores: DataFrame, id_col: str = "id", score_col: str = "size") -> DataFrame:
    """leaf, standard or hub by position in ascending order; a lone element is standard."""
    placed = before(scores.select(id_col, score_col), [score_col, id_col])
    at = F.col("_before") / (F.col("_total") - 1)
    return placed.select(id_col, F.when(F.col("_total") == 1, "standard").when(at < 1 / 3, "leaf").when(at > 2 / 3, "hub").otherwise("standard").alias("band"))
