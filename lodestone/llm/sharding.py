"""Sharding by histogram sort, in DataFrame functions only.

Rows are ordered by (hash of the text, id), so equal texts lie together. The shard boundaries are
found without sorting: in each round the exact bytes below a few candidate boundaries are counted in
one aggregation, and the interval that holds each splitter shrinks, until the bytes below it are
within the tolerance of its target. Then every row knows its shard, and one exchange moves the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestone.session import materialise

_LOW, _HIGH = -(2**63), 2**63 - 1


@dataclass
class _Splitter:
    """A boundary in search: bytes below ``low`` stay under the target, those below ``high`` reach it."""

    target: float
    low: tuple[int, int] = (_LOW, _LOW)
    high: tuple[int, int] = (_HIGH, _HIGH)
    below_low: int = 0
    below_high: int = 0
    found: tuple[int, int] | None = None


def _below(key: tuple[int, int]) -> Column:
    return (F.col("_k") < F.lit(key[0])) | ((F.col("_k") == F.lit(key[0])) & (F.col("_d") < F.lit(key[1])))


def _interval(bounds: list[tuple[int, int]], start: int = 0) -> Column:
    """Number of bounds at or below the row's key, by a balanced tree of comparisons."""
    if not bounds:
        return F.lit(start)
    mid = len(bounds) // 2
    return F.when(_below(bounds[mid]), _interval(bounds[:mid], start)).otherwise(_interval(bounds[mid + 1 :], start + mid + 1))


def _probes(low: tuple[int, int], high: tuple[int, int], count: int) -> list[tuple[int, int]]:
    """Keys spread over (low, high): between two hashes by hash, within one hash by id."""
    if high[0] - low[0] > 1:
        first, last = low[0], high[0]
        return sorted({(first + (last - first) * k // (count + 1), _LOW) for k in range(1, count + 1)} - {low, high})
    # Only the hash low[0], and ids of high[0] below high[1], are left.
    if high[0] == low[0]:
        first, last, hash_ = low[1], high[1], low[0]
    elif low[1] < _HIGH:
        # The hash of low ends where that of high begins.
        return sorted({(low[0], low[1] + (_HIGH - low[1]) * k // (count + 1)) for k in range(1, count + 1)} - {low, high})
    else:
        return []
    return sorted({(hash_, first + (last - first) * k // (count + 1)) for k in range(1, count + 1)} - {low, high})


def splitters(sized: DataFrame, shards: int, tolerance: float, probes: int = 8, rounds: int = 60) -> list[tuple[int, int]]:
    """Boundaries between ``shards`` ranges of ``(_k, _d)`` with near equal sums of ``size``."""
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    slack = tolerance * total / shards
    open_ = [_Splitter(total * k / shards, below_high=total) for k in range(1, shards)]
    for _ in range(rounds):
        searching = [s for s in open_ if s.found is None]
        if not searching:
            break
        ends = {e for s in searching for e in (s.low, s.high)} - {(_LOW, _LOW), (_HIGH, _HIGH)}
        bounds = sorted(ends.union(*(_probes(s.low, s.high, probes) for s in searching)))
        edges = [(_LOW, _LOW), *bounds, (_HIGH, _HIGH)]
        counted = {r["_i"]: r for r in sized.groupBy(_interval(bounds).alias("_i")).agg(F.sum("size").alias("size"), F.min(F.struct("_k", "_d")).alias("first"), F.max(F.struct("_k", "_d")).alias("last")).collect()}
        sums, total_below = [], 0
        for k in range(len(bounds)):
            total_below += counted[k]["size"] if k in counted else 0
            sums.append(total_below)
        for s in searching:
            for key, below in zip(bounds, sums):
                if s.low < key < s.high:
                    if below <= s.target:
                        s.low, s.below_low = key, below
                    else:
                        s.high, s.below_high = key, below
                        break
            # The rows left between low and high start and end at real keys; jump to these.
            inner = [counted[k] for k in counted if edges[k] >= s.low and edges[k + 1] <= s.high]
            if inner and s.below_high > s.below_low:
                first = min(tuple(r["first"]) for r in inner)
                last = max(tuple(r["last"]) for r in inner)
                s.low, after = max(s.low, first), (last[0], last[1] + 1) if last[1] < _HIGH else (last[0] + 1, _LOW)
                s.high = min(s.high, after)
            near = min(((abs(s.below_low - s.target), s.low), (abs(s.below_high - s.target), s.high)))
            single = bool(inner) and min(tuple(r["first"]) for r in inner) == max(tuple(r["last"]) for r in inner)
            if near[0] <= slack or single or not inner or not _probes(s.low, s.high, probes):
                s.found = near[1]
    else:
        if any(s.found is None for s in open_):
            raise RuntimeError(f"splitters did not settle in {rounds} rounds")
    return sorted(s.found for s in open_)


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.002, slots_per_task: int = 5_000, bytes_per_task: int = 16_000_000, most_tasks: int = 200_000) -> DataFrame:
    """All rows and columns of ``docs`` with ``_size``, ``_shard`` and ``_slot``.

    The law is ``bytes``: sums of size, the UTF-8 bytes of the text (null: none) plus 1, are near
    equal over the shards, within the tolerance (a share of a shard) where keys allow: rows with both
    text and id equal can't be told apart and stay together, other copies of a text may be split by
    id, by ``shards - 1`` boundaries at most. ``_slot`` numbers the rows of a shard from 0 without a
    gap; rows with both equal are numbered in one task, all others in tasks of about ``bytes_per_task``
    bytes, or larger ones where that would make more than ``most_tasks``. Rows with a null id or text take
    part like any others. An empty table gives none. Columns of ``docs`` may have any names; those
    with one of the three new names are replaced.
    """
    own = [c for c in docs.columns if c.lower() not in ("_size", "_shard", "_slot")]
    text = F.col(text_col).cast("string")
    keyed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in own)).alias("_row"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("_size"),
        F.xxhash64(F.coalesce(text, F.lit("")), text.isNull()).alias("_k"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(_LOW)).alias("_d"),
    )
    sized = materialise(keyed.select(F.col("_size").alias("size"), "_k", "_d"), "sizes")
    bounds = splitters(sized, shards, tolerance)
    n_rows, n_bytes = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks = min(most_tasks, max(shards, -(-n_bytes // bytes_per_task)))
    # Several parts a task, or chance would make some tasks much larger than others.
    parts = max(1, -(-n_rows // (shards * slots_per_task)), -(-4 * tasks // shards))
    place = {"_shard": _interval(bounds).cast("int"), "_part": F.pmod(F.xxhash64("_d", "_k"), F.lit(parts)).cast("int")}
    counts = sized.withColumns(place).groupBy("_shard", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    order = Window.partitionBy("_shard", "_part").orderBy("_k", "_d")
    # This exchange is the only one of the rows: the window and the join find them already dealt by their keys.
    dealt = keyed.withColumns(place).repartition(tasks, "_shard", "_part")
    numbered = dealt.withColumn("_at", F.row_number().over(order))
    placed = numbered.join(starts, ["_shard", "_part"])
    return placed.select("_row.*", "_size", "_shard", (F.col("_start") + F.col("_at") - 1).alias("_slot"))
