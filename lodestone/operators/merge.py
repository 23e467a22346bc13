"""Merging fragments of facts: evidence union, scalar conflicts by priority, best coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestone.functions import evidence as ev

# Priority of an extractor by name; others have DEFAULT_PRIORITY.
PRIORITY = {"build_graph": 100, "cmake": 100, "msbuild_cpp": 100, "cpp_facts": 50, "clang_deps": 50, "csharp_facts": 50, "runtime": 40, "contracts": 30}
DEFAULT_PRIORITY = 10


def fragment_priority(extractors: Column) -> Column:
    """Highest priority of a fragment's extractors."""
    table = F.create_map(*(F.lit(x) for pair in PRIORITY.items() for x in pair))
    return F.coalesce(F.array_max(F.transform(extractors, lambda name: F.coalesce(table[name], F.lit(DEFAULT_PRIORITY)))), F.lit(DEFAULT_PRIORITY))


def merge_evidence(items: DataFrame, order: str = "fragment") -> DataFrame:
    """Items of several fragments by edge, type and detail: counts summed if any has one, first visibility.

    ``first`` means in the order of ``order``; the aggregation combines before it shuffles.
    """
    return items.groupBy("source", "target", "type", "detail").agg(
        F.sum("count").cast("long").alias("count"),
        F.min_by("visibility", F.when(F.col("visibility").isNotNull(), F.col(order))).alias("visibility"),
    )


def edges_of(items: DataFrame) -> DataFrame:
    """Edges with their evidence as a sorted array and all derived columns."""
    item = F.struct("type", "detail", "count", "visibility")
    return ev.derived(items.groupBy("source", "target").agg(F.array_sort(F.collect_list(item)).alias("evidence")))


def scalar_winner(values: DataFrame, key: str = "id", field: str = "value", priority: str = "priority", order: str = "fragment") -> DataFrame:
    """Value of each key as an ordered fold over the fragments leaves it.

    The priority is tracked per key, not per value: a fragment without the value still raises it. A
    higher priority replaces, an equal one takes the smaller text, a lower one is ignored.
    """
    row = F.struct(F.col(order).alias("o"), F.col(priority).cast("int").alias("p"), F.col(field).alias("v"))
    start = F.struct(F.lit(-1).alias("p"), F.lit(None).cast("string").alias("v"))

    def step(state: Column, x: Column) -> Column:
        fresh = x["v"].isNotNull()
        value = (
            F.when(fresh & ((x["p"] > state["p"]) | (state["p"] == -1)), x["v"])
            .when(fresh & (x["p"] == state["p"]), F.coalesce(F.least(state["v"], x["v"]), x["v"]))
            .otherwise(state["v"])
        )
        return F.struct(F.greatest(state["p"], x["p"]).alias("p"), value.alias("v"))

    folded = values.groupBy(key).agg(F.aggregate(F.array_sort(F.collect_list(row)), start, step, lambda s: s["v"]).alias(field))
    return folded


def conflict_ledger(values: DataFrame, key: str = "id", field: str = "value") -> DataFrame:
    """Values that lost against the one with the highest priority, ties to the smaller text."""
    order = Window.partitionBy(key).orderBy(F.desc("priority"), field, "fragment")
    best = values.where(F.col(field).isNotNull()).withColumns({"kept": F.first(field).over(order), "winner_priority": F.first("priority").over(order)})
    lost = best.where(F.col(field) != F.col("kept"))
    return lost.groupBy(key, "kept", "winner_priority", F.col(field).alias("dropped")).agg(F.max("priority").alias("loser_priority"))


def external_flag(values: DataFrame) -> DataFrame:
    """``external`` by the highest priority; a tie between both values is false."""
    top = values.groupBy("id").agg(F.max("priority").alias("priority"))
    return values.join(top, ["id", "priority"]).groupBy("id").agg(F.bool_and("external").alias("external"))


def best_coverage(rows: DataFrame) -> DataFrame:
    """Best value of each target and layer."""
    rank = ev.coverage_rank(F.col("value"))
    return rows.groupBy("id", "layer").agg(F.max(F.struct(rank.alias("rank"), "value")).alias("best")).select("id", "layer", F.col("best.value").alias("value"))


def union_lists(rows: DataFrame, key: str, column: str) -> DataFrame:
    """Sorted distinct union of a list column."""
    return rows.select(key, F.explode(column).alias("x")).groupBy(key).agg(F.array_sort(F.collect_set("x")).alias(column))


def apply_aliases(items: DataFrame, aliases: DataFrame) -> DataFrame:
    """Evidence items with renamed endpoints, merged anew; edges that collapse to a loop stay loops."""
    a = aliases.select(F.col("id").alias("_old"), F.col("new_id").alias("_new"))
    out = items
    for end in ("source", "target"):
        out = out.join(a, F.col(end) == F.col("_old"), "left").withColumn(end, F.coalesce("_new", end)).drop("_old", "_new")
    return merge_evidence(out)


def evidence_ceiling(edges: DataFrame, ceiling: str) -> DataFrame:
    """Edges with evidence up to a layer; those left without any go."""
    most = {"L0": 0, "L1": 1, "L2": 2, "L3": 3}[ceiling]
    kept = edges.withColumn("evidence", F.filter("evidence", lambda e: ev.layer_rank(e["type"]) <= most)).where(F.size("evidence") > 0)
    return ev.derived(kept)


def referential_integrity(targets: DataFrame, edges: DataFrame) -> DataFrame:
    """Problems of a model: ends that no target has, and edges without evidence."""
    ids = targets.select(F.col("id").alias("_id"))
    ends = [edges.join(ids, F.col(end) == F.col("_id"), "left_anti").select(F.lit(f"dangling_{end}").alias("problem"), "source", "target") for end in ("source", "target")]
    bare = edges.where(F.size("evidence") == 0).select(F.lit("no_evidence").alias("problem"), "source", "target")
    return ends[0].unionByName(ends[1]).unionByName(bare)
