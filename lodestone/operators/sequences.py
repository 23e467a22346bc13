"""Neighbours in ordered sequences, however long one sequence is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lodestone.operators import ranking
from lodestone.operators.skew import join_counted
from lodestone.session import materialise


def previous(rows: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """``rows`` with ``_previous``: ``value`` of the row before in the same ``key``, by ``order``; null for the first.

    All rows are dealt into ranges of key and order, so a key with any share of the rows lies in many
    ranges; the first row of a range looks at the last of the range before, one row a range.
    """
    by = [*key, *order]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id()})
    ranged = materialise(ranged.withColumn("_own", F.struct(*key, F.col(value).alias("_v"))), "sequence")
    ends = ranged.groupBy("_p").agg(F.max_by("_own", "_i").alias("_end"))
    ends = ends.select("_p", F.lag("_end").over(Window.orderBy("_p")).alias("_end"))
    inside = Window.partitionBy("_p").orderBy("_i")
    before = F.coalesce(F.lag("_own").over(inside), "_end")
    same = F.lit(True)
    for k in key:
        same = same & F.col(f"_before.{k}").eqNullSafe(F.col(k))
    known = ranged.join(F.broadcast(ends), "_p").withColumn("_before", before)
    return known.withColumn("_previous", F.when(same, F.col("_before._v"))).drop("_p", "_i", "_own", "_end", "_before")


def numbered(rows: DataFrame, key: list[str], order: list[str], name: str = "index") -> DataFrame:
    """``rows`` with their number within ``key`` from 1, by ``order``; no task holds a whole key."""
    placed = materialise(ranking.before(rows, [*key, *order]), "numbered")
    firsts = materialise(placed.groupBy(*key).agg(F.min("_before").alias("_first"), F.count("*").alias("n")), "firsts")
    total = firsts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    out = join_counted(placed.drop("_total"), firsts, key, total).withColumn(name, F.col("_before") - F.col("_first") + 1)
    return out.select(*rows.columns, name)


def hops(rows: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """``key, order, from, to`` where the value changes along a sequence: repeats in a row are one, null values are passed over."""
    known = previous(rows.where(F.col(value).isNotNull()).select(*key, *order, value), key, order, value)
    return known.where(F.col("_previous") != F.col(value)).select(*key, *order, F.col("_previous").alias("from"), F.col(value).alias("to"))
