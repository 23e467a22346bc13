"""Exact top-k search by tiled matrix products.

Candidates are packed into shards and queries into blocks, one matrix each, bounded in rows and in
bytes. Groups of blocks and groups of shards meet in the cells of a grid: a task keeps the blocks of
its cell and lets the shards stream past, so a matrix moves once per group of the other side and not
once per tile. Every tile is one matrix product and a partial selection; the short lists of a query
are merged as a tree: the tiles of a cell first, then ``branch`` lists a level until one is left.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lodestone.operators.skew import join_counted
from lodestone.session import materialise

_TOP = "query_id long, piece long, ids array<long>, scores array<long>"
_LONG = 2**63
#: Codes from here on are multiplied as Python integers.
_HUGE = 2.0**60
#: A component counts as the floor of this many times itself; a power of two, so the product is exact.
_UNIT = 256
#: Bytes of one matrix, and of the blocks that a task keeps, at most (one vector at least).
_MATRIX, _RESIDENT = 16_000_000, 64_000_000


def _usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def _limbs(values: np.ndarray, bits: int, count: int) -> list[np.ndarray]:
    """``values`` as a sum of ``count`` parts k times 2 to the power ``bits * k``, the least first; exact for integers."""
    out = []
    for _ in range(count - 1):
        high = np.floor(values / 2.0**bits)
        out.append(values - high * 2.0**bits)
        values = high
    return [*out, values]


def _wide(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Products of codes below ``_HUGE`` by limbs whose own products are exact in double precision."""
    bits = max(1, (52 - int(np.ceil(np.log2(max(2, queries.shape[1]))))) // 2)
    count = -(-61 // bits)
    left, right = _limbs(queries, bits, count), _limbs(rows, bits, count)
    near, exact = np.zeros((len(queries), len(rows))), np.zeros((len(queries), len(rows)), np.uint64)
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            part, shift = a @ b.T, bits * (i + j)
            near += part * 2.0**shift
            if shift < 64:
                exact += part.astype(np.int64).astype(np.uint64) << np.uint64(shift)
    out = exact.view(np.int64)
    out[near >= _LONG] = _LONG - 1
    out[near <= -_LONG] = -_LONG
    # So near to the ends of 64 bits the sum in double precision can't tell the side.
    for q, r in np.argwhere(np.abs(np.abs(near) - _LONG) < 2.0**24):
        out[q, r] = _whole(queries[q : q + 1], rows[r : r + 1])[0, 0]
    return out


def _whole(queries: np.ndarray, rows: np.ndarray, unit: int = 1) -> np.ndarray:
    # What has no fraction is multiplied as an integer: no double may hold its product.
    code = lambda x: int(x) * unit if abs(x) >= 2.0**52 else math.floor(x * unit)
    exact = lambda values: np.array([[code(x) for x in row] for row in values.tolist()], object).reshape(values.shape)
    return np.clip(exact(queries).dot(exact(rows).T), -_LONG, _LONG - 1).astype(np.int64).reshape(len(queries), len(rows))


def products(queries: np.ndarray, rows: np.ndarray, unit: int = 1) -> np.ndarray:
    """Integer inner products of floor(``unit`` x), exact; those beyond a signed 64-bit number become its nearest end.

    Only vectors with a code of ``_HUGE`` or more leave the matrix products.
    """
    if not queries.size or not rows.size:
        return np.zeros((len(queries), len(rows)), np.int64)
    with np.errstate(over="ignore"):
        left, right = np.floor(queries * unit), np.floor(rows * unit)
        high = [np.abs(m).max(1) for m in (left, right)]
        if high[0].max() * high[1].max() * queries.shape[1] < 2.0**53:
            return (left @ right.T).astype(np.int64)
    big = [h >= _HUGE for h in high]
    out = _wide(np.where(big[0][:, None], 0, left), np.where(big[1][:, None], 0, right))
    if big[0].any():
        out[big[0]] = _whole(queries[big[0]], rows, unit)
    if big[1].any():
        out[:, big[1]] = _whole(queries, rows[big[1]], unit)
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores with their ids, ties to the smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
        scores, ids = scores[near], ids[near]
    order = np.lexsort((ids, ~scores))[:k]
    return scores[order], ids[order]


def _size(tile: int) -> Column:
    """Vectors of a matrix at most."""
    return F.greatest(F.lit(1), F.least(F.lit(tile), F.floor(_MATRIX / (8 * F.greatest(F.col("dim"), F.lit(1))))))


def _packed(rows: DataFrame, parts: str) -> DataFrame:
    """Vectors of equal length as binary matrices of a bounded size, numbered from 0 to ``parts``."""

    def run(key, part: pd.DataFrame) -> pd.DataFrame:
        ids = part["vec_id"].to_numpy(np.int64)
        return pd.DataFrame({"dim": [key[0]], "n_shards": [key[1]], "n_blocks": [key[2]], "number": [key[3]], "ids": [ids.tobytes()], "matrix": [b"".join(np.asarray(x, np.float64).tobytes() for x in part["vector"])]})

    dealt = rows.select("dim", "n_shards", "n_blocks", F.pmod(F.xxhash64("row"), parts).alias("number"), "vec_id", "vector")
    return dealt.groupBy("dim", "n_shards", "n_blocks", "number").applyInPandas(run, "dim int, n_shards long, n_blocks long, number long, ids binary, matrix binary")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", tile: int = 2048, branch: int = 16) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` highest integer inner products.

    A component x counts as floor(256 x), x as double, whole numbers of any size included. Candidates are all rows but the query's own,
    that is those with another id; equal scores go to the smaller id; with fewer candidates all are
    returned. Vectors that are null or hold null or non-finite components, and rows with a null id,
    take no part; vectors of different lengths are never compared, empty ones score 0 with each other.
    Rows of one id, equal or not, are candidates of their own, and as queries share one list, to which
    each brings its own. Scores beyond 64 bits become the nearest 64-bit number. Other columns are
    ignored; an empty table gives none.
    """
    vector = F.col(vector_col)
    good = vectors.where(_usable(vector) & F.col(id_col).isNotNull())
    rows = materialise(good.select(F.col(id_col).cast("long").alias("vec_id"), is_query.alias("asked"), vector.cast("array<double>").alias("vector"), F.size(vector).alias("dim"), F.monotonically_increasing_id().alias("row")), "vectors")
    counted = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("asked").alias("n_asked")).where("n_asked > 0")
    counted = materialise(counted.select("dim", "n", F.ceil(F.col("n") / _size(tile)).alias("n_shards"), F.ceil(F.col("n_asked") / _size(tile)).alias("n_blocks")), "dims")
    total, most, most_asked = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n_shards"), F.lit(0)), F.coalesce(F.max("n_blocks"), F.lit(0))).first()
    sized = materialise(join_counted(rows, counted, ["dim"], total), "sized")
    shards, blocks = _packed(sized, "n_shards"), _packed(sized.where("asked"), "n_blocks")
    # Groups of as many matrices as a task may keep.
    width = F.greatest(F.lit(1), F.least(F.lit(branch), F.floor(_RESIDENT / (8 * F.greatest(F.col("dim"), F.lit(1)) * _size(tile)))))
    group = F.floor(F.col("number") / width)
    across = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / width)))
    left = blocks.select("dim", group.alias("c"), across("n_shards").alias("r"), F.lit(0).alias("side"), "ids", "matrix")
    right = shards.select("dim", across("n_blocks").alias("c"), group.alias("r"), F.lit(1).alias("side"), "ids", "matrix")
    cells = left.unionByName(right).repartition("dim", "c", "r").sortWithinPartitions("dim", "c", "r", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, kept, held = None, [], {}

        def matrix(ids: bytes, values: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
            ids = np.frombuffer(ids, np.int64)
            return ids, np.frombuffer(values).reshape(len(ids), dim)

        for batch in batches:
            for at in range(batch.num_rows):
                dim, c, r, side, ids, values = (column[at].as_py() for column in batch.columns)
                if (dim, c, r) != cell:
                    if held:
                        yield _batch(held, cell[1] * most + cell[2])
                    cell, kept, held = (dim, c, r), [], {}
                if not side:
                    kept.append(matrix(ids, values, dim))
                    continue
                ids, candidates = matrix(ids, values, dim)
                for asked, queries in kept:
                    for query, own in zip(asked.tolist(), products(queries, candidates, _UNIT)):
                        other = ids != query
                        top = best(own, ids, k) if other.all() else best(own[other], ids[other], k)
                        if query in held:
                            top = best(*map(np.concatenate, zip(held[query], top)), k)
                        held[query] = top
        if held:
            yield _batch(held, cell[1] * most + cell[2])

    lists = cells.mapInArrow(run, _TOP)
    order = lambda column: F.slice(F.sort_array(column, asc=False), 1, k)
    merged = lists.select("query_id", "piece", F.transform(F.arrays_zip("scores", "ids"), lambda x: F.struct(x["scores"].alias("score"), F.bitwise_not(x["ids"]).alias("m"))).alias("top"))
    left_over = max(1, most * most_asked)
    while True:
        merged = merged.groupBy("query_id", F.floor(F.col("piece") / branch).alias("piece")).agg(order(F.flatten(F.collect_list("top"))).alias("top"))
        left_over = -(-left_over // branch)
        if left_over == 1:
            break
    ranked = merged.select("query_id", F.posexplode("top").alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.bitwise_not("x.m").alias("vec_id"), F.col("x.score").alias("score"))


def _batch(held: dict, piece: int) -> pa.RecordBatch:
    tops = list(held.values())
    return pa.RecordBatch.from_arrays(
        [pa.array(list(held), pa.int64()), pa.array([piece] * len(held), pa.int64()), pa.array([t[1].tolist() for t in tops], pa.list_(pa.int64())), pa.array([t[0].tolist() for t in tops], pa.list_(pa.int64()))],
        ["query_id", "piece", "ids", "scores"],
    )
