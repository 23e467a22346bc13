"""Traversals by both ways, against plain versions; routing of questions; the façade's envelope."""

import itertools

import numpy as np
import pytest

from lodestone.functions import texts
from lodestone.operators import components, findings, graph, ownership, query
from lodestone.sources import deploy


@pytest.fixture(params=["one task", "frontier"])
def way(request, monkeypatch):
    if request.param == "frontier":
        monkeypatch.setattr(graph, "LOCAL", -1)
    return request.param


def random_edges(seed, nodes=40, edges=70):
    rng = np.random.default_rng(seed)
    return sorted({(f"n{a:02}", f"n{b:02}") for a, b in rng.integers(0, nodes, (edges, 2))})


def paths_from(edges, seed):
    """Least path by length, then by nodes, to every node."""
    best, front = {seed: [seed]}, [[seed]]
    while front:
        longer = sorted(p + [b] for p in front for a, b in edges if a == p[-1] and b not in best)
        front = []
        for p in longer:
            if p[-1] not in best:
                best[p[-1]] = p
                front.append(p)
    return best


def test_reach_with_paths(spark, way):
    edges = random_edges(1)
    table = spark.createDataFrame(edges + [("n01", None), (None, "n02")], "source string, target string")
    seeds = spark.createDataFrame([("n00",), ("n05",), ("n05",), ("nowhere",), (None,)], "id string")
    got = {(r.seed, r.node): (r.depth, r.path) for r in graph.reach(table, seeds, paths=True).collect()}
    want = {(s, n): (len(p) - 1, p) for s in ("n00", "n05") for n, p in paths_from(edges, s).items() if n != s}
    assert got == want
    plain = graph.reach(table, seeds).collect()
    assert {(r.seed, r.node): r.depth for r in plain} == {k: d for k, (d, _) in want.items()} and len(plain) == len(want)


def test_long_paths_are_read_in_few_tables(spark, way):
    edges = [(k, k + 1) for k in range(30)]
    got = graph.reach(spark.createDataFrame(edges, "source long, target long"), spark.createDataFrame([(0,)], "id long")).collect()
    assert {(r.node, r.depth) for r in got} == {(k, k) for k in range(1, 31)}
    if way == "frontier":
        with pytest.raises(RuntimeError):
            graph.reach(spark.createDataFrame(edges, "source long, target long"), spark.createDataFrame([(0,)], "id long"), rounds=5)


def test_strong_components_and_loops(spark, way):
    for seed in (3, 4) if way == "one task" else (3,):
        edges = random_edges(seed, 30, 45) + [("z1", "z1"), ("n00", "n00"), ("z2", "z3")]
        reach = {n: set(paths_from(edges, n)) for n in {x for e in edges for x in e}}
        want = {}
        for n in reach:
            own = [m for m in reach if m in reach[n] and n in reach[m]]
            if len(own) > 1:
                want[n] = min(own)
        table = spark.createDataFrame(edges, "source string, target string")
        # By frontier, with groups of edges solved by a task each, and by rounds alone.
        assert {r.node: r.component for r in graph.strong_components(table).collect()} == want
        if way == "frontier":
            assert {r.node: r.component for r in graph.strong_components(table, held=0).collect()} == want
        loops = {a: a for a, b in edges if a == b and a not in want}
        assert "z1" in loops and {r.node: r.component for r in graph.cycles(table).collect()} == want | loops
    assert graph.strong_components(table.limit(0)).count() == 0


def test_shortest_paths_do_not_grow_with_their_number(spark, way):
    """A ladder of ten rungs has 2 ** 10 shortest paths; ten come, the first in order."""
    edges = [e for k in range(10) for e in ((f"s{k}", f"a{k}"), (f"s{k}", f"b{k}"), (f"a{k}", f"s{k + 1}"), (f"b{k}", f"s{k + 1}"))]
    got = [r.path for r in graph.shortest_paths(spark.createDataFrame(edges, "source string, target string"), "s0", "s10").collect()]
    every = sorted(" > ".join(["s0"] + [x for k, c in enumerate(w) for x in (f"{c}{k}", f"s{k + 1}")]) for w in itertools.product("ab", repeat=10))
    assert got == every[:10]
    assert graph.shortest_paths(spark.createDataFrame(edges, "source string, target string"), "s10", "s0").count() == 0


def test_components_of_hot_nodes_and_their_order(spark):
    edges = [(9000, k) for k in range(3000)] + [(0, 5000 + k) for k in range(2000)] + [(20_000, 20_001), (30_000, 30_001), (40_000, 40_001), (40_001, 40_002), (7, 7), (None, 3)]
    table = spark.createDataFrame(edges, "src long, dst long")
    got = components.connected_components(table)
    assert sorted(map(tuple, components.connected_components(table, local=10_000).collect())) == sorted(map(tuple, got.collect()))
    assert components.connected_components(table.limit(0), local=10).count() == 0
    named = {r.node: r.component for r in got.collect()}
    assert len(named) == 3000 + 2000 + 1 + 2 + 2 + 3 and set(named.values()) == {0, 20_000, 30_000, 40_000}
    order = {r.component: (r.size, r.position) for r in graph.ordered_components(got).collect()}
    assert order == {0: (5001, 1), 40_000: (3, 2), 20_000: (2, 3), 30_000: (2, 4)}


@pytest.mark.parametrize(
    "question, primitive",
    [
        ("What depends on core?", "dependents"), ("which service depends on core", "dependents"), ("Who depends on core?", "dependents"), ("list the dependents of core", "dependents"),
        ("what does core depend on", "dependencies"), ("dependencies of core", "dependencies"), ("What breaks if core changes?", "blast_radius"), ("blast radius of core", "blast_radius"),
        ("impact of core", "blast_radius"), ("is core in a cycle", "cycles_of"), ("May core use ui? Is it allowed?", "conformance_of"), ("does core conform", "conformance_of"),
        ("path from core to ui", "paths_between"), ("can core reach ui", "paths_between"), ("why is core there", "explain_of"), ("explain core", "explain_of"), ("hello core", None),
    ],
)
def test_questions_go_to_their_primitive(question, primitive):
    assert texts.question_route(question) == primitive


@pytest.fixture(scope="module")
def model(spark):
    targets = [("t:a", "Alpha", "c:x", False), ("t:b", "Beta", "c:x", False), ("t:c", "Gamma", "c:y", False), ("t:d", "Delta", "c:y", False), ("t:web", "Web", "c:z", False)]
    edges = [("t:a", "t:b", 3), ("t:b", "t:c", 2), ("t:a", "t:c", 1), ("t:c", "t:d", 5), ("t:d", "t:d", 1)]
    t = spark.createDataFrame(targets, "id string, name string, container_id string, external boolean")
    e = spark.createDataFrame([(*x, [], "link", "low", False) for x in edges], "source string, target string, weight long, evidence array<struct<type:string,detail:string>>, evidence_strength string, confidence string, is_declared_dependency boolean")
    coverage = spark.createDataFrame([(x[0], "L0", "true") for x in targets], "id string, layer string, value string")
    return query.Model(t, e, coverage)


def test_transitive_answers_tell_the_way(model):
    got = [(r.node, r.depth, r.path) for r in model.dependencies("Alpha", transitive=True).rows.collect()]
    assert got == [("t:b", 1, ["t:a", "t:b"]), ("t:c", 1, ["t:a", "t:c"]), ("t:d", 2, ["t:a", "t:c", "t:d"])]
    assert [r.node for r in model.ask("What depends on Gamma?").rows.collect()] == ["t:b", "t:a"]


def test_a_loop_is_a_cycle_and_answers_carry_the_model(model, spark):
    found = [(r.altitude, r.component, r.node) for r in model.cycles_of("Delta").rows.collect()]
    assert found == [("target", "t:d", "t:d")]
    again = query.Model(model.targets.orderBy("name"), model.edges.repartition(3), model.coverage)
    other = query.Model(model.targets.where("id <> 't:d'"), model.edges, model.coverage)
    assert model.blast_radius("Web").model_hash == again.hash != other.hash


def test_names_are_whole_words_wherever_they_stand(model):
    assert model.mentioned("Webhook of web, Alpha_2, and Beta with t:a or BETA") == ["Web", "Alpha", "Beta", "t:a"]


def test_ids_of_an_answer(model):
    answer = model.dependencies("Alpha", transitive=True)
    assert {r.id for r in query.ids_in(answer.rows, model.targets).collect()} == {"t:a", "t:b", "t:c", "t:d"}
    assert query.ids_in(answer.rows.select("depth"), model.targets).count() == 0


def test_ancestors_without_a_top_end_at_the_root(spark):
    links = spark.createDataFrame([("c", "b"), ("b", "a"), ("x", "y"), ("y", "x")], "child string, parent string")
    seeds = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    assert sorted(map(tuple, ownership.ancestor_chains(seeds("c", "b", "a"), links).collect())) == [("b", 1, "a"), ("c", 2, "a/b")]
    assert sorted(map(tuple, ownership.ancestor_chains(seeds("c", "b"), links, top="b").collect())) == [("c", 1, "b")]
    with pytest.raises(ValueError, match="circle"):
        ownership.ancestor_chains(seeds("x"), links)


def test_every_row_of_a_file_keeps_its_owner(spark):
    files = spark.createDataFrame([("src/a/f.c", 1), ("src/a/f.c", 1), ("lib/g.c", 2)], "path string, n int")
    owners = spark.createDataFrame([("src",), ("src/a",)], "owner string")
    assert sorted(map(tuple, ownership.longest_prefix(files, owners).collect())) == [("src/a/f.c", 1, "src/a"), ("src/a/f.c", 1, "src/a")]


def test_anchors_are_the_smallest(spark):
    members = spark.createDataFrame([("a/readme.md", 900), ("z/README", 10), ("a/main.c", 70), ("b/main.c", 60)], "path string, size long")
    none = spark.createDataFrame([], "src string, dst string")
    assert {(r.why, r.path) for r in findings.anchors(members, none).collect()} == {("readme", "z/README"), ("entry", "b/main.c")}


def test_images_by_whole_segments():
    kinds = {"postgres:15": "database", "host:5000/postgres": "database", "host:5000/team/redis:7@sha256:ab": "cache", "bitnami/kafka": "queue", "mypostgres": None, "postgres/extra": "database", "a/postgres/b": None, "": None}
    assert {image: deploy.infra_kind(image) for image in kinds} == kinds
