"""Connected components by alternating large-star and small-star steps.

Every step is a ``groupBy().min`` and an equi-join, so the edge list never meets in one task and the
driver sees only a count and a checksum. Edges never outnumber the input's by more than its nodes.
A node in very many edges, as the root of a large component is in the end, is joined in memory. All
others are joined by a shuffle, said so: compressed edges look small enough to go through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lodestone.operators.skew import HEAD
from lodestone.session import materialise


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _lowest(edges: DataFrame, key: str, total: int) -> DataFrame:
    """``edges`` with ``low``: the smallest neighbour below the node in ``key``, that node itself where it has none."""
    low = edges.groupBy(F.col("a").alias(key)).agg(F.min("b").alias("low"))
    hot = edges.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") * HEAD >= total).select(key)
    near = F.coalesce("low", key).alias("low")
    # At most HEAD nodes have so many of the edges. Sides of an outer join are not to be chosen: the small one is here on the right.
    known = F.broadcast(hot.join(F.broadcast(low.join(F.broadcast(hot), key, "left_semi")), key, "left").select(key, near))
    head = edges.join(known, key).select("a", "b", "low")
    tail = edges.join(F.broadcast(hot), key, "left_anti").join(low.hint("merge"), key, "left").select("a", "b", near)
    return head.unionByName(tail)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    return _lowest(edges, "b", total).select("a", F.col("low").alias("b")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    near = _lowest(edges, "a", total)
    pairs = F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b"))))
    return near.select(pairs.alias("p")).select("p.a", "p.b").where("a <> b").distinct()


def _at_once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    root: dict = {}

    def find(x):
        top = x
        while root.setdefault(top, top) != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    if root:
        yield pd.DataFrame({"node": list(root), "component": [find(x) for x in list(root)]})


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 60, local: int = 0) -> DataFrame:
    """Component of every node that has an edge to another: ``(node, component)``.

    ``component`` is the smallest node reachable. Nodes without an edge, self loops and edges with a
    null end give no row: the caller's ``coalesce(component, node)`` covers them. At most ``local``
    edges, counted, are joined by one task in memory, with the same result.
    """
    a, b = F.col(src), F.col(dst)
    current = materialise(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    before = _fingerprint(current)
    if before[0] <= local:
        kind = dict(current.dtypes)["a"]
        return materialise(current.coalesce(1).mapInPandas(_at_once, f"node {kind}, component {kind}"), "components")
    for _ in range(rounds):
        if not before[0]:
            break
        large = materialise(_large_star(current, before[0]), "edges")
        current = materialise(_small_star(large, before[0]), "edges")
        now = _fingerprint(current)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
