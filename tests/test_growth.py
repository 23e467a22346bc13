"""What grew too fast or stopped: rings behind long ways, dense graphs, ways without forks, names that many share, joins through the driver."""

import re

import pytest

from lodestone.operators import components, graph, interop, lift, ownership
from lodestone.plans import growing, registry

SF = "/root/testdata/sf0.001"


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "source long, target long")


def joins_of(frame):
    return set(re.findall(r"BroadcastHashJoin|SortMergeJoin", frame._jdf.queryExecution().executedPlan().toString()))


@pytest.mark.parametrize("turned", [False, True])
def test_rings_behind_long_ways_take_few_rounds(spark, turned):
    """Sixty nodes lead into a ring of three and one falls from it; others end; the turned graph has the same components."""
    pairs = [(k, k + 1) for k in range(100, 160)] + [(160, 7), (7, 9), (9, 8), (8, 7)] + [(200, 100), (201, 9), (300, 301), (301, 302), (40, 41), (41, 40), (5, 5)]
    pairs = [(b, a) for a, b in pairs] if turned else pairs
    got = {r.node: r.component for r in graph.strong_components(edges_of(spark, pairs), rounds=5, local=0).collect()}
    assert got == {7: 7, 8: 7, 9: 7, 40: 40, 41: 40}
    assert graph.strong_components(edges_of(spark, [(1, 2), (2, 3)]), local=0).count() == 0


def test_cycles_of_ways_without_forks(spark):
    pairs = [(k, k + 1) for k in range(100, 160)] + [(160, 100), (3, 100), (3, 3)]
    edges = edges_of(spark, pairs)
    assert {r.node: r.component for r in graph.cycles(edges, local=0).collect()} == {k: 100 for k in range(100, 161)} | {3: 3}


def test_boundaries_meet_names_not_targets(spark):
    """Many targets share a name: no join may return a row for each of them."""
    targets = spark.range(500).selectExpr("id", "'Same' AS name", "IF(id = 0, array('A', 'B', 'b'), array('A')) AS com_provides", "IF(id < 2, 'shared_lib', 'static_lib') AS type")
    boundaries = spark.createDataFrame([("x", "A"), ("y", "b"), ("z", "B"), ("z", "b"), ("w", "none"), ("v", "SAME"), ("u", "libSame.so")], "id string, name string")
    assert {r.boundary: r.target for r in interop.resolve_com(boundaries, targets).collect()} == {"y": 0, "z": 0}
    assert interop.resolve_managed(boundaries, targets).count() == 0
    assert {r.boundary: r.target for r in interop.resolve_native(boundaries, targets.where("id > 0")).collect()} == {"v": 1, "u": 1}
    for found in (interop.resolve_com(boundaries, targets), interop.resolve_managed(boundaries, targets), interop.resolve_native(boundaries, targets)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert len(re.findall(r"(?m)^\W*Aggregate", plan)) == 2 and plan.index("Join") < plan.rindex("Aggregate")


def test_peeled_where_every_name_comes_with_every_beginning(spark, tmp_path):
    """Enough parts of few names: half of the distinct names begin with ``app``, four fifths of the parts do."""
    spark.range(700).selectExpr("id AS p_partkey", "IF(id % 2 = 0, 'large ring', 'hot bolt') AS p_name").write.parquet(f"{tmp_path}/part.parquet")
    got = {(r.entity, r.label) for r in registry.QUERIES["clusters_peeled"](spark, str(tmp_path)).collect()}
    assert got == {(f"{a}{c}{n}", n.split(".")[0]) for a in ("", "app.") for c in ("", "core.") for n in ("large.ring", "hot.bolt")}


def test_ways_without_forks_take_few_tables(spark, monkeypatch):
    """Three seeds on a way of a hundred nodes into a ring: tables by its digits, not its length."""
    written, write = [], graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda frame, name="table": written.append(name) or write(frame, name))
    edges = edges_of(spark, [(k, k + 1) for k in range(100)] + [(100, 90), (500, 3), (600, 601)])
    seeds = spark.createDataFrame([(0,), (500,), (100,), (601,), (9999,)], "id long")
    got = {(r.seed, r.node): (r.depth, r.path) for r in graph.reach(edges, seeds, paths=True, local=0).collect()}
    want = {}
    for seed, way in ((0, list(range(101))), (500, [500, *range(3, 101)]), (100, [100, *range(90, 100)])):
        want |= {(seed, way[k]): (k, way[: k + 1]) for k in range(1, len(way))}
    assert got == want and len(written) < 25
    assert {(r.seed, r.node): r.depth for r in graph.reach(edges, seeds, local=0).collect()} == {k: d for k, (d, _) in want.items()}
    with pytest.raises(RuntimeError):
        graph.reach(edges, seeds, local=0, rounds=100)
    assert graph.reach(edges, seeds, local=0, rounds=101).count() == len(want)


def test_edges_do_not_go_through_the_driver(spark):
    """Edges look small as compressed files; of a join with all of them only hot nodes may be sent to all tasks."""
    low = components._lowest(edges_of(spark, [(k, k // 2) for k in range(2, 5000)]).toDF("a", "b"), "b", 5000)
    plan = low._jdf.queryExecution().optimizedPlan().toString()
    outer = [line for line in plan.split("\n") if re.search("LeftOuter|RightOuter", line)]
    assert len(outer) == 2 and all("LeftOuter" in line and re.search(r"rightHint=\(strategy=(merge|broadcast)\)", line) for line in outer)


def test_chains_do_not_go_through_the_driver(spark, monkeypatch):
    plans, write = [], ownership.materialise
    monkeypatch.setattr(ownership, "materialise", lambda frame, name="table": plans.append(joins_of(frame)) or write(frame, name))
    links = spark.range(1, 40).selectExpr("id AS child", "id div 3 AS parent")
    got = {r.id: (r.depth, r.chain) for r in ownership.ancestor_chains(links.selectExpr("child AS id"), links, top=0).collect()}
    assert got[39] == (4, "0/1/4/13") and len(got) == 39
    assert plans and all(p == {"SortMergeJoin"} for p in plans)


def test_degrees_by_counted_parts(spark):
    edges = spark.createDataFrame([(1, 2, 3), (2, 1, 4), (1, 3, 5), (1, 2, 1)], "source_container long, target_container long, weight long")
    want = {1: (3, 1, 2, 13), 2: (1, 2, 1, 8), 3: (0, 1, 1, 5)}
    for rows in (0, 4, 1_000_000):
        assert {r.node: (r.efferent, r.afferent, r.neighbours, r.weight) for r in lift.degree(edges, rows=rows).collect()} == want
    plan = lift.degree(edges, rows=1_000_000)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(node#\d+L, near#\d+L, 5\), REPARTITION_BY_NUM", plan)


def test_steps_are_dealt_by_their_number(spark, monkeypatch):
    plans, write = [], growing.materialise
    monkeypatch.setattr(growing, "materialise", lambda frame, name="table": plans.append(frame._jdf.queryExecution().executedPlan().toString()) or write(frame, name))
    growing.steps_of(spark, SF)
    assert plans[0].count("REPARTITION_BY_NUM") == 2


def test_dense_graphs_begin_with_a_thin_part(spark, monkeypatch):
    """Two dense parts joined by an edge each way, and by one way only; results as by plain walks."""
    thin, part = [], graph._thinned
    monkeypatch.setattr(graph, "_thinned", lambda edges: thin.append(1) or part(edges))
    inside = lambda lo: [(lo + a, lo + b) for a in range(24) for b in range(24) if a != b and (a * 7 + b * 3) % 4]
    pairs = inside(0) + inside(100) + inside(200) + [(3, 104), (110, 9), (5, 201), (204, 300), (300, 301), (400, 0)]
    got = {r.node: r.component for r in graph.strong_components(edges_of(spark, pairs), local=0).collect()}
    assert thin and got == {k: 0 for k in [*range(24), *range(100, 124)]} | {k: 200 for k in range(200, 224)}
