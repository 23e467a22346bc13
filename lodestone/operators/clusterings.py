"""Plain clusterings of entities by their names, degradations of a model, and planned mutations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodestone.functions import evidence as ev
from lodestone.operators import ranking


def by_leaf(nodes: DataFrame) -> DataFrame:
    """Cluster of each entity: its parent path, or ``.``."""
    return nodes.select("entity", F.when(F.col("entity").contains("/"), F.regexp_replace("entity", "/[^/]*$", "")).otherwise(".").alias("label"))


def by_top(nodes: DataFrame, depth: int = 2) -> DataFrame:
    """Cluster of each entity: its first ``depth`` path segments without the last of all."""
    cut = F.split("entity", "/")
    return nodes.select("entity", F.when(F.size(cut) > 1, F.array_join(F.slice(cut, 1, F.least(F.lit(depth), F.size(cut) - 1)), "/")).otherwise(".").alias("label"))


def by_name(nodes: DataFrame, separator: str = r"\.") -> DataFrame:
    """Cluster of each entity: the first token after those that all entities share."""
    tokens = nodes.select("entity", F.split("entity", separator).alias("t"))
    ends = tokens.agg(F.min("t").alias("a"), F.max("t").alias("b"))
    # The shared beginning of the smallest and the largest is that of all.
    shared = F.size(F.filter(F.sequence(F.lit(1), F.least(F.size("a"), F.size("b"))), lambda k: F.slice("a", 1, k) == F.slice("b", 1, k)))
    common = ends.select(shared.alias("k"))
    return tokens.join(F.broadcast(common)).select("entity", F.coalesce(F.get("t", F.col("k")), F.element_at("t", -1)).alias("label"))


def peeled(nodes: DataFrame, separator: str = r"\.", share: float = 0.5, rounds: int = 4) -> DataFrame:
    """Cluster of each entity: its first token once leading tokens of most rows are gone."""
    rows = nodes.select("entity", F.split("entity", separator).alias("t"))
    total = rows.count()
    for _ in range(rounds):
        top = rows.where(F.size("t") > 1).groupBy(F.col("t")[0].alias("x")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "x").first()
        if top is None or top["n"] <= share * total:
            break
        rows = rows.withColumn("t", F.when((F.size("t") > 1) & (F.col("t")[0] == top["x"]), F.slice("t", 2, F.size("t"))).otherwise(F.col("t")))
    return rows.select("entity", F.col("t")[0].alias("label"))


def removed(nodes: DataFrame, step: int) -> DataFrame:
    """Every ``step``-th entity in order."""
    return ranking.every(nodes, step, ["entity"])


def lose_layer(edges: DataFrame, coverage: DataFrame, layer: str) -> tuple[DataFrame, DataFrame]:
    """A model without one layer: edges that only it produced go, its coverage is false."""
    kept = edges.where(~(ev.layers(F.col("evidence")) == F.array(F.lit(layer))))
    return kept, coverage.withColumn("value", F.when(F.col("layer") == layer, "false").otherwise(F.col("value")))


def starve(edges: DataFrame, coverage: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A model that lost its evidence of some targets: their edges go, their coverage is false."""
    gone = targets.select(F.col("id").alias("_g"))
    kept = edges.join(gone, F.col("source") == F.col("_g"), "left_anti").join(gone, F.col("target") == F.col("_g"), "left_anti")
    marked = coverage.join(gone.withColumn("_x", F.lit(True)), F.col("id") == F.col("_g"), "left")
    return kept, marked.select("id", "layer", F.when(F.col("_x"), "false").otherwise(F.col("value")).alias("value"))


def classified(expected: DataFrame, drift: DataFrame, gaps: DataFrame, advisory: bool) -> DataFrame:
    """Each injected finding (``kind, key``) as drift, gap, advisory or silent."""
    joined = expected.join(drift.select("kind", "key", F.lit(True).alias("_d")).distinct(), ["kind", "key"], "left").join(gaps.select("kind", "key", F.lit(True).alias("_g")).distinct(), ["kind", "key"], "left")
    outcome = F.when(F.col("_d") & ~F.lit(advisory), "drift").when(F.col("_g"), "gap").when(F.lit(advisory), "advisory").otherwise("silent")
    return joined.select("kind", "key", outcome.alias("outcome"))


def detection(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """True positives, misses and false alarms of findings."""
    both = expected.select(*keys, F.lit(1).alias("e")).distinct().join(found.select(*keys, F.lit(1).alias("f")).distinct(), keys, "full_outer")
    return both.agg(F.count_if(F.col("e").isNotNull() & F.col("f").isNotNull()).alias("tp"), F.count_if(F.col("f").isNull()).alias("fn"), F.count_if(F.col("e").isNull()).alias("fp"))
