"""Traversals and strong components.

Graphs of up to ``LOCAL`` edges (counted, not guessed) are solved by one task in memory: a round of
a distributed traversal costs more than such a graph's whole solution. Larger graphs go by frontier:
each round is an equi-join of the frontier with the edges, written once, so plans stay small and a
lost executor costs a re-read. Both ways give the same rows. Graphs without forks, whose ways may be
very long, take steps that double instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from lodestone.operators.skew import join_counted
from lodestone.session import materialise

#: Edges, and edges times seeds, that one task solves.
LOCAL, LOCAL_WALKS = 200_000, 20_000_000
#: Edges a node from which strong components begin with a thin part of the edges.
DENSE = 8
_ARROW = " > "


def _steps(edges: DataFrame, src: str, dst: str, name: str) -> DataFrame:
    return materialise(edges.select(F.col(src).alias("_a"), F.col(dst).alias("_b")).where("_a IS NOT NULL AND _b IS NOT NULL AND _a <> _b").distinct(), name)


def _neighbours(batches: Iterator[pd.DataFrame]) -> tuple[dict, dict]:
    """Sorted followers of each node, and of a start the nodes named for it, from rows ``kind, _a, _b``."""
    after, starts = {}, {}
    for batch in batches:
        for kind, a, b in zip(batch["kind"].tolist(), batch["_a"].tolist(), batch["_b"].tolist()):
            (after if kind else starts).setdefault(a, []).append(b)
    for near in after.values():
        near.sort()
    return after, starts


def _in_one_task(edges: DataFrame, run, schema: str, starts: DataFrame | None = None) -> DataFrame:
    rows = edges.select(F.lit(1).alias("kind"), "_a", "_b")
    if starts is not None:
        rows = rows.unionByName(starts.select(F.lit(0).alias("kind"), "_a", F.col("_a").alias("_b")))
    return materialise(rows.coalesce(1).mapInPandas(run, schema), "local")


class _Levels:
    """Tables of a traversal, a few whatever its depth: four of one rank become one of the next, so a row is written again but a few times."""

    def __init__(self) -> None:
        self.tables: list[tuple[int, DataFrame]] = []

    def add(self, table: DataFrame) -> None:
        self.tables.append((0, table))
        while len(self.tables) >= 4 and len({rank for rank, _ in self.tables[-4:]}) == 1:
            rank, merged = self.tables[-1][0], self.all(4)
            self.tables[-4:] = [(rank + 1, materialise(merged, "levels"))]

    def all(self, last: int = 0) -> DataFrame:
        out = None
        for _, table in self.tables[-last:]:
            out = table if out is None else out.unionByName(table)
        return out


def reach(edges: DataFrame, seeds: DataFrame, src: str = "source", dst: str = "target", rounds: int = 100_000, paths: bool = False, until=None, local: int | None = None) -> DataFrame:
    """``seed, node, depth``: nodes that each seed reaches, itself left out, by the least number of steps.

    ``paths`` adds ``path``, of the shortest paths to the node the first in the order of its nodes. With
    ``until``, a node, levels beyond its first may be missing. ``local`` stands for ``LOCAL``. Raises if
    nodes are still found after ``rounds`` steps.
    """
    steps = _steps(edges, src, dst, "steps")
    kind = dict(steps.dtypes)["_a"]
    first = materialise(seeds.select(F.col("id").cast(kind).alias("_a")).where("_a IS NOT NULL").distinct(), "seeds")
    n_edges, n_seeds = steps.count(), first.count()
    if n_edges <= (LOCAL if local is None else local) and n_edges * max(1, n_seeds) <= LOCAL_WALKS:
        found = _in_one_task(steps, _walk_all, f"seed {kind}, node {kind}, depth int, path array<{kind}>", first)
        return found if paths else found.drop("path")
    if _forkless(steps, n_edges):
        return _follow(steps, n_edges, first, rounds, paths)
    start = first.select(F.col("_a").alias("seed"), F.col("_a").alias("node"), F.lit(0).alias("depth"), *([F.array("_a").alias("path")] if paths else []))
    frontier, levels = materialise(start, "seen"), _Levels()
    levels.add(frontier)
    for depth in range(1, rounds + 1):
        near = frontier.join(steps, F.col("node") == F.col("_a"))
        if paths:
            found = near.select("seed", F.col("_b").alias("node"), F.array_append("path", F.col("_b")).alias("path")).groupBy("seed", "node").agg(F.min("path").alias("path"))
        else:
            found = near.select("seed", F.col("_b").alias("node")).distinct()
        fresh = found.join(levels.all().select("seed", "node"), ["seed", "node"], "left_anti")
        frontier = materialise(fresh.select("seed", "node", F.lit(depth).alias("depth"), *(["path"] if paths else [])), "frontier")
        if frontier.isEmpty():
            break
        levels.add(frontier)
        if until is not None and not frontier.where(F.col("node") == until).isEmpty():
            break
    else:
        raise RuntimeError(f"nodes are still found after {rounds} steps")
    return levels.all().where("depth > 0")


def _follow(steps: DataFrame, n: int, first: DataFrame, rounds: int, paths: bool) -> DataFrame:
    """``reach`` where no node has two followers: what is found so far, and that by steps as long again."""
    found = materialise(first.select(F.col("_a").alias("seed"), F.col("_a").alias("node"), F.lit(0).alias("depth")), "seen")
    n_found, far, length = found.count(), steps, 1
    while n:
        # Many seeds may have come to one node.
        many = found.groupBy(F.col("node").alias("_a")).agg(F.count("*").alias("n")).join(far.hint("merge"), "_a")
        onward = join_counted(found.withColumn("_a", F.col("node")), many, ["_a"], n_found, shuffled=True).select("seed", F.col("_b").alias("node"), (F.col("depth") + length).alias("depth"))
        found = materialise(found.unionByName(onward).groupBy("seed", "node").agg(F.min("depth").alias("depth")), "seen")
        before, n_found = n_found, found.count()
        if n_found == before:
            break
        if length >= rounds:
            raise RuntimeError(f"nodes are still found after {rounds} steps")
        far, length = _doubled(far, n), 2 * length
        n = far.count()
    if not found.where(F.col("depth") >= rounds).isEmpty():
        raise RuntimeError(f"nodes are still found after {rounds} steps")
    if paths:
        way = found.groupBy("seed").agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "node"))), lambda x: x["node"]).alias("_way"))
        found = found.join(way.hint("merge"), "seed").select("seed", "node", "depth", F.slice("_way", F.lit(1), F.col("depth") + 1).alias("path"))
    return found.where("depth > 0")


def _walk_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    after, starts = _neighbours(batches)
    for seed in starts:
        came, order = {seed: None}, [seed]
        depth = {seed: 0}
        # Followers in order, nodes in the order they are found: the first path is the least.
        for node in order:
            for near in after.get(node, ()):
                if near not in came:
                    came[near], depth[near] = node, depth[node] + 1
                    order.append(near)
        for at in range(1, len(order), 10_000):
            part = order[at : at + 10_000]
            ways = []
            for node in part:
                way = []
                while node is not None:
                    way.append(node)
                    node = came[node]
                ways.append(way[::-1])
            yield pd.DataFrame({"seed": [seed] * len(part), "node": part, "depth": [depth[n] for n in part], "path": ways})


def shortest_paths(edges: DataFrame, start: str, end: str, most: int = 10, src: str = "source", dst: str = "target", local: int | None = None) -> DataFrame:
    """Shortest paths between two nodes as text, in order, ``most`` of them at most.

    The paths grow backward from the end; of a node only its ``most`` least suffixes go on, for with the
    same beginning the order of paths is that of their suffixes.
    """
    steps = materialise(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).distinct(), "steps")
    spark = edges.sparkSession
    seeds = spark.createDataFrame([(start,)], "id string")
    depths = materialise(reach(steps, seeds, "a", "b", until=end, local=local).select("node", "depth").unionByName(spark.createDataFrame([(start, 0)], "node string, depth int")), "depths")
    goal = depths.where(F.col("node") == end).first()
    paths = spark.createDataFrame([(end, end)], "node string, path string")
    if goal is None:
        return paths.where(F.lit(False)).select("path", F.lit(0).alias("hops"))
    on_way = steps.join(depths.withColumnRenamed("depth", "da"), F.col("a") == F.col("node")).drop("node").join(depths.withColumnRenamed("depth", "db"), F.col("b") == F.col("node")).drop("node").where("db = da + 1")
    on_way = materialise(on_way.select("a", "b", "da"), "on_way")
    order = Window.partitionBy("node").orderBy("path")
    for depth in range(goal["depth"] - 1, -1, -1):
        longer = paths.join(on_way.where(F.col("da") == depth), F.col("node") == F.col("b")).select(F.col("a").alias("node"), F.concat("a", F.lit(_ARROW), "path").alias("path"))
        paths = longer.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r")
        if (goal["depth"] - depth) % 4 == 0:
            paths = materialise(paths, "paths")
    return paths.where(F.col("node") == start).select("path", F.lit(goal["depth"]).alias("hops")).orderBy("path").limit(most)


def _components_at_once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Strong components by two passes: nodes in the order they are left, then backward from the last."""
    after, _ = _neighbours(batches)
    before: dict = {}
    for a, near in after.items():
        for b in near:
            before.setdefault(b, []).append(a)
    left, seen = [], set()
    for root in after:
        if root in seen:
            continue
        seen.add(root)
        way = [(root, iter(after[root]))]
        while way:
            node, rest = way[-1]
            for near in rest:
                if near not in seen:
                    seen.add(near)
                    way.append((near, iter(after.get(near, ()))))
                    break
            else:
                left.append(node)
                way.pop()
    nodes, named, taken = [], [], set()
    for root in reversed(left):
        if root in taken:
            continue
        taken.add(root)
        group = [root]
        for node in group:
            for near in before.get(node, ()):
                if near not in taken:
                    taken.add(near)
                    group.append(near)
        if len(group) > 1:
            nodes += group
            named += [min(group)] * len(group)
    if nodes:
        yield pd.DataFrame({"node": nodes, "component": named})


def _least(edges: DataFrame, labels: DataFrame, rounds: int) -> DataFrame:
    """``node, label``: the least label of the nodes that reach a node along ``a -> b``, its own included.

    Labels are ``struct<order, node>``. In a round a node takes the least label of those before it, and then
    that which the labelled node has itself: who reaches the label reaches the node. Over nodes
    each less than all before it a label still moves one step a round.
    """
    current, total = labels, labels.count()
    for _ in range(rounds):
        # A label may have any share of the nodes.
        owner = current.select(F.col("node").alias("_l"), F.col("label").alias("_further"))
        used = current.groupBy(F.col("label.node").alias("_l")).agg(F.count("*").alias("n")).join(owner.hint("merge"), "_l")
        jumped = join_counted(current.withColumn("_l", F.col("label.node")), used, ["_l"], total, shuffled=True).select("node", "label", "_further")
        near = edges.join(jumped.select(F.col("node").alias("_n"), "_further").hint("merge"), F.col("a") == F.col("_n")).groupBy("b").agg(F.min("_further").alias("_near"))
        least = F.least("_further", F.coalesce("_near", "_further"))
        current = materialise(jumped.join(near.hint("merge"), F.col("node") == F.col("b"), "left").select("node", least.alias("label"), (least < F.col("label")).alias("moved")), "labels")
        if current.where("moved").isEmpty():
            return current.select("node", "label")
    raise RuntimeError(f"labels did not settle in {rounds} rounds")


def _doubled(steps: DataFrame, n: int) -> DataFrame:
    """``_a, _b`` two steps on, where ``n`` rows ``_a, _b`` lead from each ``_a`` one step on. Many may lead to one node."""
    onward = steps.groupBy("_b").agg(F.count("*").alias("n")).join(steps.select(F.col("_a").alias("_b"), F.col("_b").alias("_further")).hint("merge"), "_b")
    return materialise(join_counted(steps, onward, ["_b"], n, shuffled=True).select("_a", F.col("_further").alias("_b")), "doubled")


def _forkless(steps: DataFrame, n: int) -> bool:
    """Whether no two of the ``n`` steps start in one node."""
    return steps.select("_a").distinct().count() == n


def _rings(steps: DataFrame, n: int) -> DataFrame:
    """``node, component`` of the rings of a graph in which no node has two followers: its strong components of two or more.

    Only nodes that some node leads to go on, by ever longer steps. Once each of them is led to, the steps
    permute them: then all are in rings. Both this and the least of a ring take as many rounds as the
    longest way has binary digits.
    """
    far = steps
    while n:
        kept = materialise(far.join(far.select(F.col("_b").alias("_a")).distinct().hint("merge"), "_a", "left_semi"), "rings")
        n_kept = kept.count()
        if n_kept == n:
            break
        far = _doubled(kept, n_kept)
        n = far.count()
    ring = materialise(steps.join(far.select("_a").hint("merge"), "_a", "left_semi").select("_a", "_b", F.least("_a", "_b").alias("low"), F.lit(True).alias("moved")), "rings")
    while not ring.where("moved").isEmpty():
        ahead = ring.select(F.col("_a").alias("_b"), F.col("_b").alias("_further"), F.col("low").alias("_low"))
        ring = materialise(ring.join(ahead.hint("merge"), "_b").select("_a", F.col("_further").alias("_b"), F.least("low", "_low").alias("low"), (F.col("_low") < F.col("low")).alias("moved")), "rings")
    return ring.select(F.col("_a").alias("node"), F.col("low").alias("component"))


def _thinned(edges: DataFrame) -> DataFrame:
    """At most two edges ``a -> b`` out of each node and two into each, chosen by hash."""
    out = None
    for near, far in (("a", "b"), ("b", "a")):
        pick = F.struct(F.xxhash64("a", "b").alias("h"), F.col(far))
        ends = edges.groupBy(near).agg(F.array(F.min(pick), F.max(pick)).alias("x")).select(near, F.explode("x").alias("x")).select(near, f"x.{far}").select("a", "b")
        out = ends if out is None else out.unionByName(ends)
    return materialise(out.distinct(), "thin")


def _inside(edges: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """``edges`` between nodes of one label, the label in ``name``."""
    for end in ("a", "b"):
        edges = edges.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"_{end}")).hint("merge"), end)
    kept = [c for c in edges.columns if c not in ("_a", "_b")]
    return edges.where("_a = _b").select(*kept, F.col("_a").alias(name))


def strong_components(edges: DataFrame, src: str = "source", dst: str = "target", rounds: int = 200, local: int | None = None, held: int = LOCAL, dense: bool | None = None) -> DataFrame:
    """``node, component``: the smallest node of each strongly connected component of two or more.

    Beyond ``local`` edges (``LOCAL`` if not given): nodes get an order by hash; each takes the least node
    that reaches it, and, within those of one such label, the least that it reaches. Where both are the same
    node, the nodes are that node's component. Others of one component agree in both, so only edges between
    nodes that agree go on: as graphs of their own, solved by a task each where they have at most ``held``
    edges, and by another round, with another order, beyond. Raises if nodes are left after ``rounds``.

    A graph in which no node has two followers, or none two before it, is solved by steps that double. Of a
    graph with over ``DENSE`` edges a node, a thin part is solved first: its components are within those of
    the whole, so each becomes one node, and of the whole only edges between these nodes are left.
    """
    left = _steps(edges, src, dst, "scc").withColumnsRenamed({"_a": "a", "_b": "b"})
    kind = dict(left.dtypes)["a"]
    bound = LOCAL if local is None else local
    n = left.count()
    if n <= bound:
        return _in_one_task(left.withColumnsRenamed({"a": "_a", "b": "_b"}), _components_at_once, f"node {kind}, component {kind}")
    for end, other in (("a", "b"), ("b", "a")):
        one_way = left.select(F.col(end).alias("_a"), F.col(other).alias("_b"))
        if _forkless(one_way, n):
            return _rings(one_way, n)
    if dense is None:
        dense = n > DENSE * left.select(F.explode(F.array("a", "b")).alias("node")).distinct().count()
    if dense:
        inner = materialise(strong_components(_thinned(left), "a", "b", rounds, local, held, False), "inner")
        for end in ("a", "b"):
            left = left.join(inner.select(F.col("node").alias(end), F.col("component").alias("_c")).hint("merge"), end, "left").withColumn(end, F.coalesce("_c", end)).drop("_c")
        outer = materialise(strong_components(left, "a", "b", rounds, local, held, False), "outer")
        # Components of the thin part have grown, or stay; their least nodes stand for them.
        grown = inner.join(outer.select(F.col("node").alias("component"), F.col("component").alias("_c")).hint("merge"), "component", "left").select("node", F.coalesce("_c", "component").alias("component"))
        return grown.unionByName(outer.join(inner.select("node").hint("merge"), "node", "left_anti"))
    found = []

    def by_task(inner: DataFrame) -> DataFrame:
        """Solve the groups of ``a, b, group`` that a task holds; the rest is returned."""
        sizes = materialise(inner.groupBy("group").agg(F.count("*").alias("n")), "sizes")
        small = inner.join(sizes.where(F.col("n") <= held), "group").select("group", F.col("a").alias("_a"), F.col("b").alias("_b"))
        found.append(materialise(small.groupBy("group").applyInPandas(_one_group, f"node {kind}, component {kind}"), "component"))
        # Large groups are few: their edges outnumber ``held``.
        return inner.join(sizes.where(F.col("n") > held).select("group"), "group")

    for turn in range(rounds):
        # What has no edge in or none out is no component of two.
        ends = left.join(left.select(F.col("b").alias("a")).distinct().hint("merge"), "a", "left_semi").join(left.select(F.col("a").alias("b")).distinct().hint("merge"), "b", "left_semi")
        left = materialise(ends.select("a", "b"), "scc")
        nodes = left.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        labels = materialise(nodes.select("node", F.struct(F.xxhash64("node", F.lit(turn)).alias("order"), F.col("node")).alias("label")), "labels")
        ahead = _least(left, labels, rounds)
        same = materialise(by_task(_inside(left, ahead, "ahead").withColumn("group", F.xxhash64("ahead.node"))), "same")
        if same.isEmpty():
            break
        own = same.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        back = _least(same.select(F.col("b").alias("a"), F.col("a").alias("b")), materialise(labels.join(own.hint("merge"), "node", "left_semi"), "labels"), rounds)
        group = ahead.join(back.withColumnRenamed("label", "_back").hint("merge"), "node").where("label = _back").select(F.col("label.node").alias("root"), "node")
        names = group.groupBy("root").agg(F.min("node").alias("component"), F.count("*").alias("n")).where("n > 1")
        n_group = group.count()
        found.append(materialise(join_counted(group, names, ["root"], n_group, shuffled=True).select("node", "component"), "component"))
        open_ = _inside(same.select("a", "b", "ahead"), back, "back").where("ahead <> back")
        left = materialise(by_task(open_.select("a", "b", F.xxhash64("ahead.node", "back.node").alias("group"))).select("a", "b"), "scc")
        if left.isEmpty():
            break
    else:
        raise RuntimeError(f"nodes are left after {rounds} rounds")
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def _one_group(group: pd.DataFrame) -> pd.DataFrame:
    parts = list(_components_at_once([group.assign(kind=1)]))
    return parts[0] if parts else pd.DataFrame({"node": group["_a"][:0], "component": group["_a"][:0]})


def cycles(edges: DataFrame, src: str = "source", dst: str = "target", local: int | None = None) -> DataFrame:
    """``node, component`` of all cycles: strong components, and nodes with an edge to themselves that are in none."""
    found = materialise(strong_components(edges, src, dst, local=local), "strong")
    loops = edges.where(F.col(src) == F.col(dst)).select(F.col(src).alias("node"), F.col(src).alias("component")).distinct()
    return found.unionByName(loops.join(found.select("node").hint("merge"), "node", "left_anti"))


def ordered_components(components: DataFrame) -> DataFrame:
    """``node, component, size, position`` of components, the largest first, then by their first node."""
    sizes = components.groupBy("component").agg(F.count("*").alias("size"))
    # Positions by counting the components of each size before, so that no task sorts all of them.
    by = sizes.groupBy("size").agg(F.count("*").alias("n"))
    above = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("size").orderBy("component"))
    placed = sizes.join(by.select("size", above.alias("_above")), "size").withColumn("position", F.col("_above") + within).drop("_above")
    return components.join(placed, "component").select("node", "component", "size", "position")
