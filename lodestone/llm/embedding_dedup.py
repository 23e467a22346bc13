"""Embedding near-duplicates by small-world graphs per shard.

Equal vectors of a label form a class. The classes of a large label go to the nearest of its pivots, which
are some of its own vectors; those of a pivot are dealt into shards of a bounded size, each with its graph.
Shards of a label query each other, but only with vectors near enough to the plane between their pivots to
have a link beyond it, so queries don't grow with the number of shards. Groups of shards meet in the cells
of a grid, so a shard moves once per group and not once per shard. Audits widen the beams; pairs are
verified by cosine in double precision. A cell returns the number of links of each of its classes and a
spanning forest of its links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestone.llm.hnsw import Hnsw, linked_pairs
from lodestone.operators.components import connected_components
from lodestone.operators.skew import join_counted
from lodestone.session import materialise

_ROUTED = "label string, dim int, class long, rep long, copies long, vector array<double>, cell long"
_SHARD = "label string, dim int, n_shards long, shard long, cell long, classes binary, reps binary, copies binary, vectors binary, graph binary"
_TILE = "class long, rep long, n_links long, root long"
_KEY = ["label", "k1", "k2"]
#: Bytes of vectors in the shards that a task keeps of one group, at most (one shard at least).
_RESIDENT = 32_000_000


def _usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    return F.coalesce(vector.isNotNull() & ~bad & some, F.lit(False))


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _stacked(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors])


def _route(key, part: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
    """Rows of ``part`` with the cell of the nearest pivot."""
    cell = np.zeros(len(part), np.int64)
    if len(part) and len(pivots):
        unit, centres = _unit(_stacked(part["vector"])), _unit(_stacked(pivots["pivot"]))
        step = max(1, 4_000_000 // len(centres))
        nearest = [(unit[at : at + step] @ centres.T).argmax(1) for at in range(0, len(unit), step)]
        cell = pivots["cell"].to_numpy(np.int64)[np.concatenate(nearest)]
    return part.drop(columns="chunk").assign(cell=cell)


def _build(key, part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("class", kind="stable")
    vectors = _stacked(part["vector"])
    classes, reps, copies = (part[c].to_numpy(np.int64).tobytes() for c in ("class", "rep", "copies"))
    return pd.DataFrame({"label": [key[0]], "dim": [key[1]], "n_shards": [key[2]], "shard": [key[3]], "cell": [key[4]], "classes": [classes], "reps": [reps], "copies": [copies], "vectors": [vectors.tobytes()], "graph": [Hnsw(_unit(vectors)).dump()]})


class _Shard:
    def __init__(self, group: int, row: dict):
        self.group, self.number = group, row["shard"]
        self.classes, self.reps, self.copies = (np.frombuffer(row[c], np.int64) for c in ("classes", "reps", "copies"))
        self.unit = _unit(np.frombuffer(row["vectors"]).reshape(len(self.classes), row["dim"]))
        self.pivot = None if row["pivot"] is None else _unit(np.array([row["pivot"]], np.float64))[0]
        self.graph = Hnsw.load(row["graph"], self.unit)


def visitors(a: _Shard, b: _Shard, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of ``a`` that have to query ``b``, and of ``b`` that have to query ``a``, so that no link is missed.

    Each vector is nearest to its own pivot, so the plane halfway between the pivots parts the shards, and the
    distances of two linked vectors from it, one on either side, add up to at most their own. So a link has
    an end in ``a`` within any share of that, or one in ``b`` within the rest; the share taken has fewest queries.
    """
    if a.pivot is None or b.pivot is None:
        return np.arange(len(a.unit)), np.arange(len(b.unit))
    across = a.pivot - b.pivot
    far_a, far_b = a.unit @ across, -(b.unit @ across)
    # More than what roundings of the cosine and of the products come to.
    room = np.linalg.norm(across) * np.sqrt(max(0.0, 2 - 2 * least)) + 1e-6
    shares = [(far_a <= part * room + 1e-9, far_b <= (1 - part) * room + 1e-9) for part in np.linspace(0, 1, 9)]
    near_a, near_b = min(shares, key=lambda s: s[0].sum() + s[1].sum())
    return np.flatnonzero(near_a), np.flatnonzero(near_b)


def link_shards(a: _Shard, b: _Shard, least: float) -> pa.RecordBatch | None:
    """Links between two shards, or within one: number per class, and the smallest id of each local group."""
    same = a is b
    if same:
        x, y, _ = linked_pairs(b.graph, b.unit, a.unit, least, same)
        x, y = np.concatenate([x, y]), np.concatenate([y, x])
        x, y, offset = x[x < y], y[x < y], 0
    else:
        from_a, from_b = visitors(a, b, least)
        x, y, _ = linked_pairs(b.graph, b.unit, a.unit[from_a], least)
        v, u, _ = linked_pairs(a.graph, a.unit, b.unit[from_b], least)
        x, y, offset = np.concatenate([from_a[x], u]), np.concatenate([y, from_b[v]]), len(a.classes)
    pairs = np.unique(np.stack([x, y + offset], 1).reshape(-1, 2), axis=0)
    if not len(pairs):
        return None
    classes, reps, copies = (getattr(a, c) if same else np.concatenate([getattr(a, c), getattr(b, c)]) for c in ("classes", "reps", "copies"))
    x, y = pairs.T
    links, root = np.zeros(len(classes), np.int64), reps.copy()
    np.add.at(links, x, copies[y])
    np.add.at(links, y, copies[x])
    while True:
        before, low = root.copy(), np.minimum(root[x], root[y])
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        if (root == before).all():
            break
    some = links > 0
    return pa.RecordBatch.from_arrays([pa.array(c[some]) for c in (classes, reps, links, root)], ["class", "rep", "n_links", "root"])


def embedding_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98, shard_size: int = 4096) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    Vectors of one label with a cosine of ``least`` or more are linked. A vector that is null, zero or
    empty or holds null or non-finite components links with nothing, nor does one whose label is null;
    vectors of different lengths are never compared. Each row is a vector that counts its own links,
    those with other rows of its id included; rows of one id are one for reaching others, and so share
    a component. A row that links with nothing is its own component, whatever other rows of its id do.
    A null id keeps null as component and is kept. Other columns are ignored; an empty table gives none.
    """
    named = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.transform(vector_col, lambda x: x.cast("double")).alias("vector"))
    usable = _usable(F.col("vector")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    # Two hashes with different beginnings tell vectors apart; the vectors need not be join keys.
    keys = [F.when(usable, F.xxhash64(F.lit(k), "vector")).alias(f"k{k}") for k in (1, 2)]
    rows = materialise(named.select("vec_id", "label", *keys, "vector"), "vectors")
    good = rows.where("k1 IS NOT NULL")
    grouped = good.groupBy(*_KEY).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    classes = materialise(grouped.withColumn("class", F.monotonically_increasing_id()).withColumn("dim", F.size("vector")), "classes")
    counts = materialise(classes.groupBy("label", "dim").agg(F.count("*").alias("n")), "counts")
    known = join_counted(classes.select("label", "dim", "class", "rep", "copies", "vector"), counts, ["label", "dim"], classes.count())
    large, chunk = F.col("n") > shard_size, F.greatest(F.lit(shard_size), F.floor(_RESIDENT / (8 * F.greatest(F.col("dim"), F.lit(1)))))
    draw, cells_wanted = F.xxhash64("class", F.lit("pivot")), F.ceil(F.col("n") / shard_size)
    # Some more than are wanted, so that only few rows a label are put in order.
    drawn = known.where(large & (F.pmod(draw, "n") < 8 * cells_wanted + 32)).withColumn("draw", draw)
    pivots = drawn.withColumn("cell", F.row_number().over(Window.partitionBy("label", "dim").orderBy("draw", "class")).cast("long") - 1).where(F.col("cell") < cells_wanted)
    pivots = materialise(pivots.select("label", "dim", "cell", F.ceil(F.col("n") / chunk).alias("chunks"), F.col("vector").alias("pivot")), "pivots")
    parts = known.where(large).withColumn("chunk", F.pmod(F.xxhash64("class", F.lit("chunk")), F.ceil(F.col("n") / chunk))).drop("n")
    sides = pivots.select("label", "dim", "cell", "pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    near = parts.groupBy("label", "dim", "chunk").cogroup(sides.groupBy("label", "dim", "chunk")).applyInPandas(_route, _ROUTED)
    routed = materialise(known.where(~large).drop("n").withColumn("cell", F.lit(0).cast("long")).unionByName(near), "routed")
    sizes = routed.groupBy("label", "dim", "cell").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / shard_size))
    label = Window.partitionBy("label", "dim")
    sizes = materialise(sizes.withColumn("n_shards", F.sum("parts").over(label)).withColumn("first", F.sum("parts").over(label.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("parts")), "sizes")
    dealt = join_counted(routed, sizes, ["label", "dim", "cell"], routed.count()).withColumn("shard", F.col("first") + F.pmod(F.xxhash64("class"), "parts"))
    built = materialise(dealt.groupBy("label", "dim", "n_shards", "shard", "cell").applyInPandas(_build, _SHARD), "shards")
    shards = built.join(pivots.select("label", "dim", "cell", "pivot").hint("merge"), ["label", "dim", "cell"], "left")
    width = F.greatest(F.lit(1), F.floor(_RESIDENT / (8 * F.greatest(F.col("dim"), F.lit(1)) * F.lit(shard_size))))
    grouped = shards.withColumn("group", F.floor(F.col("shard") / width)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_shards") - 1) / width))))
    cells = grouped.select("label", "dim", F.least("group", "other").alias("i"), F.greatest("group", "other").alias("j"), "group", "shard", "classes", "reps", "copies", "vectors", "graph", "pivot")

    def link(held: list[_Shard], i: int, j: int) -> Iterator[pa.RecordBatch]:
        for a in held:
            for b in held:
                # Shards of one group meet in the cell of that group alone.
                if (a.group < b.group if i < j else a.number <= b.number) and (batch := link_shards(a, b, least)) is not None:
                    yield batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                own = (row["label"], row["dim"], row["i"], row["j"])
                if own != cell:
                    if held:
                        yield from link(held, *cell[2:])
                    cell, held = own, []
                held.append(_Shard(row["group"], row))
        if held:
            yield from link(held, *cell[2:])

    groups = F.ceil(F.col("n_shards") / width)
    heavy = sizes.where("first = 0").agg(F.sum(groups * (groups + 1) / 2)).first()[0] or 0
    # A cell is much work on few bytes: with the number of tasks told, Spark doesn't join small ones.
    tasks = max(1, min(4 * int(heavy), 4000))
    found = materialise(cells.repartition(tasks, "label", "dim", "i", "j").sortWithinPartitions("label", "dim", "i", "j").mapInArrow(run, _TILE), "links")
    again = good.groupBy("vec_id").agg(F.min(F.struct(*_KEY)).alias("lo"), F.max(F.struct(*_KEY)).alias("hi")).where("lo <> hi").select("vec_id")
    total = good.count()
    own = join_counted(good.select("vec_id", *_KEY).join(again, "vec_id"), classes.select(*_KEY, "rep", F.col("copies").alias("n")), _KEY, total)
    joined = connected_components(found.select(F.col("rep").alias("src"), F.col("root").alias("dst")).unionByName(own.select(F.col("vec_id").alias("src"), F.col("rep").alias("dst"))))
    summed = found.groupBy("class").agg(F.sum("n_links").alias("more"))
    results = classes.select(*_KEY, "class", "rep", F.col("copies").alias("n")).join(summed, "class", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    results = materialise(results.select(*_KEY, "n", (F.coalesce("more", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")), "results")
    linked = join_counted(good.select("vec_id", *_KEY), results, _KEY, total).select("vec_id", "n_links", F.when(F.col("n_links") > 0, F.col("component")).otherwise(F.col("vec_id")).alias("component_id"))
    alone = rows.where("k1 IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
