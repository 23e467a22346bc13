"""Governance: coverage, drift between snapshots, layering rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodestone.functions import evidence as ev
from lodestone.functions.identifiers import basename

COVERAGE_FLOOR = 0.80


def coverage_l0(targets: DataFrame, coverage: DataFrame) -> DataFrame:
    """Share of first-party targets whose L0 value is set and not false; 0 where there are none.

    Any text counts here, "partial" and "0/n" too; only the gates per layer are stricter.
    """
    l0 = coverage.where("layer = 'L0'").select(F.col("id").alias("_id"), "value")
    first = targets.where("NOT external").join(l0, F.col("id") == F.col("_id"), "left")
    truthy = F.col("value").isNotNull() & ~F.col("value").isin("false", "")
    count, hit = F.count("*"), F.count_if(truthy)
    return first.agg(count.alias("first_party"), hit.alias("covered"), F.when(count == 0, 0.0).otherwise(hit / count).alias("coverage")).withColumn("advisory", F.col("coverage") < COVERAGE_FLOOR)


def drift_targets(baseline: DataFrame, current: DataFrame, coverage: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``id, status``: new, removed, or gap where the current run did not cover a vanished target.

    Here and below, with ``by`` the tables hold many models, told apart by these columns, and all are compared at once.
    """
    l0 = coverage.where("layer = 'L0'").select(F.col("id").alias("_c"), ev.covered(F.col("value")).alias("covered"))
    both = baseline.select(*by, "id", F.lit(True).alias("was")).join(current.select(*by, "id", F.lit(True).alias("is")), [*by, "id"], "full_outer")
    status = F.when(F.col("was").isNull(), "new").when(F.coalesce("covered", F.lit(False)), "removed").otherwise("coverage-gap")
    return both.where("was IS NULL OR is IS NULL").join(l0, F.col("id") == F.col("_c"), "left").select(*by, "id", status.alias("status"))


def drift_edges(baseline: DataFrame, current: DataFrame, coverage: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``source, target, status`` of edges in one snapshot only.

    A vanished edge is removed only where every layer that produced it is covered at both ends.
    """
    ends, keys = ["source", "target"], [*by, "source", "target"]
    new = current.join(baseline, keys, "left_anti").select(*keys, F.lit("new").alias("status"))
    gone = baseline.join(current, keys, "left_anti").select(*keys, F.explode(ev.layers(F.col("evidence"))).alias("layer"))
    cov = coverage.select(F.col("id").alias("_id"), F.col("layer").alias("_layer"), ev.covered(F.col("value")).alias("ok"))
    for end in ends:
        gone = gone.join(cov, (F.col(end) == F.col("_id")) & (F.col("layer") == F.col("_layer")), "left").withColumn(f"ok_{end}", F.coalesce("ok", F.lit(False))).drop("_id", "_layer", "ok")
    judged = gone.groupBy(*keys).agg(F.when(F.bool_and(F.col("ok_source") & F.col("ok_target")), "removed").otherwise("coverage-gap").alias("status"))
    return new.unionByName(judged)


def suspected_renames(drift: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of a removed and a new target: the only ones, or those of one base name."""
    new = drift.where("status = 'new'").select(*by, F.col("id").alias("new_id"), basename(F.col("id")).alias("_base"))
    old = drift.where("status = 'removed'").select(*by, F.col("id").alias("old_id"), basename(F.col("id")).alias("_base"))
    named = old.join(new, [*by, "_base"]).select(*by, "old_id", "new_id")
    # One row on each side at most: the counts bound the pairing.
    one = lambda status: (F.max(F.when(F.col("status") == status, F.col("id"))), F.count_if(F.col("status") == status))
    (old_id, n_old), (new_id, n_new) = one("removed"), one("new")
    single = drift.groupBy(*by).agg(old_id.alias("old_id"), new_id.alias("new_id"), n_new.alias("n_new"), n_old.alias("n_old")).where("n_new = 1 AND n_old = 1").select(*by, "old_id", "new_id")
    return named.unionByName(single).distinct()


def snapshot_diff(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows added, removed or changed between two tables with the same keys and value columns."""
    left = a.select(*keys, F.struct(*values).alias("_a"))
    right = b.select(*keys, F.struct(*values).alias("_b"))
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return left.join(right, keys, "full_outer").withColumn("status", status).where("status IS NOT NULL").select(*keys, "status")


def offending_edges(edges: DataFrame, targets: DataFrame, rules: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``rule, source, target`` of the edges that a forbidden (from, to) names; a side is a container or a target."""
    named = targets.select(*by, "id", F.explode(F.array("id", "container_id")).alias("token")).distinct()
    source = named.select(*by, F.col("id").alias("source"), F.col("token").alias("from"))
    target = named.select(*by, F.col("id").alias("target"), F.col("token").alias("to"))
    return edges.select(*by, "source", "target").join(source, [*by, "source"]).join(target, [*by, "target"]).join(rules, ["from", "to"]).select(*by, "rule", "source", "target").distinct()


def check_layering(edges: DataFrame, targets: DataFrame, coverage: DataFrame, rules: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``rule, status, n_edges`` of each forbidden (from, to): VIOLATION, UNVERIFIED or OK.

    A side names a container or a target. Without an offending edge a rule holds only where every
    target of its from side is covered for L0; otherwise it stays unverified.
    """
    hits = offending_edges(edges, targets, rules, by).groupBy(*by, "rule").agg(F.count("*").alias("n_edges"))
    named = targets.select(*by, "id", F.explode(F.array("id", "container_id")).alias("token")).distinct()
    l0 = coverage.where("layer = 'L0'").select(F.col("id").alias("_c"), ev.covered(F.col("value")).alias("ok"))
    sides = rules.join(named.withColumnRenamed("token", "from"), "from").join(l0, F.col("id") == F.col("_c"), "left").groupBy(*by, "rule").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("verified"))
    # Each model has all rules; the models are few.
    each = rules.join(F.broadcast(targets.select(*by).distinct())) if by else rules
    out = each.join(hits, [*by, "rule"], "left").join(sides, [*by, "rule"], "left")
    status = F.when(F.col("n_edges") > 0, "VIOLATION").when(F.coalesce("verified", F.lit(False)), "OK").otherwise("UNVERIFIED")
    return out.select(*by, "rule", status.alias("status"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"))
