"""Joins whose keys may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A key with at least this part of all rows is hot; so there can't be more than this many hot keys.
HEAD = 1000


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], total: int, count: str = "n", how: str = "inner", shuffled: bool = False) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row a key and in ``count`` how many of the ``total`` rows have it.

    Hot keys, at most ``HEAD`` by their counts, are joined in memory; all others by a shuffle in which
    no key has more than one in ``HEAD`` rows. ``how`` is ``inner`` or ``left``; null keys match nothing.
    ``shuffled`` says so to Spark too, for tables written by rounds, which look small as compressed files
    and would go through the driver in every round.
    """
    hot = F.col(count) * HEAD >= total
    head, tail = table.where(hot), table.where(~hot)
    tail = tail.hint("merge") if shuffled else tail
    first = rows.join(F.broadcast(head), keys)
    rest = rows.join(F.broadcast(head.select(*keys)), keys, "left_anti")
    if how == "inner":
        return first.unionByName(rest.join(tail, keys))
    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()
    new = [f for f in table.schema.fields if f.name not in keys]
    empty = rest.where(~known).select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in new))
    return first.unionByName(rest.where(known).join(tail, keys, "left")).unionByName(empty)
