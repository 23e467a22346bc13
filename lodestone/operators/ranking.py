"""Positions in a global order without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestone.session import materialise


def before(rows: DataFrame, order: list[str], count: Column | None = None) -> DataFrame:
    """``rows`` with ``_before``, the sum of ``count`` (1 each) over the rows ahead in ``order``, and ``_total``.

    Rows are dealt into ranges of the order and written once; the sums of the ranges, a row for each,
    give every range its start, and inside a range a window runs. Rows equal in ``order`` are in one
    range, each ahead of another in any way; give an order that tells rows apart, or counted values.
    """
    count = F.lit(1) if count is None else count
    ranged = materialise(rows.repartitionByRange(*order).withColumns({"_p": F.spark_partition_id(), "_c": count.cast("long")}), "ranges")
    sums = ranged.groupBy("_p").agg(F.sum("_c").alias("_s"))
    ahead = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_p", F.coalesce(F.sum("_s").over(ahead), F.lit(0)).alias("_start"), F.sum("_s").over(Window.partitionBy()).alias("_total"))
    inside = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(F.broadcast(starts), "_p").withColumn("_before", F.col("_start") + F.coalesce(F.sum("_c").over(inside), F.lit(0)))
    return placed.drop("_p", "_c", "_start")


def spread(rows: DataFrame, n: int, order: list[str]) -> DataFrame:
    """``n`` rows at even distances in order."""
    at = before(rows, order)
    hit = F.exists(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * F.col("_total") / n) == F.col("_before"))
    return at.where(hit).drop("_before", "_total")


def every(rows: DataFrame, step: int, order: list[str]) -> DataFrame:
    """Every ``step``-th row in order, the first included."""
    return before(rows, order).where(F.col("_before") % step == 0).drop("_before", "_total")
