"""Operators on small hand-made models, and the driver-side statistics against plain versions."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lodestone import session
from lodestone.functions import evidence as ev, identifiers as ids, texts
from lodestone.operators import curate, govern, graph, merge, ownership, partition, propose, risk
from lodestone.operators.components import connected_components

ITEM = "source string, target string, type string, detail string, count long, visibility string, fragment int"


def test_intermediate_tables_are_written_once_and_cleared(spark):
    kept = session.materialise(spark.range(5).withColumn("r", F.rand()), "numbers")
    assert kept.collect() == kept.collect()
    session.clear(spark)
    assert session.materialise(spark.range(3)).count() == 3


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "source string, target string")


def test_weight_and_confidence(spark):
    rows = [("a", "b", "include", "x", None, None, 1), ("a", "b", "include", "y", 99, "private", 1), ("a", "b", "symbol_use", "z", 0, None, 1), ("a", "b", "link", "l", None, None, 1),
            ("c", "d", "link", "l", None, None, 1), ("c", "d", "project_ref", "p", None, None, 1), ("e", "f", "package_ref", "q", None, None, 1), ("e", "f", "nothing", "q", None, None, 1)]
    got = {r.source: r for r in merge.edges_of(spark.createDataFrame(rows, ITEM).drop("fragment")).collect()}
    assert (got["a"].weight, got["a"].confidence, got["a"].evidence_strength) == (1 + 10 + 0 + 5, "high", "link + include + symbol_use")
    assert (got["c"].weight, got["c"].confidence, got["c"].is_declared_dependency) == (10, "low", True)
    assert (got["e"].weight, got["e"].confidence, got["e"].is_declared_dependency) == (1, "low", False)


def test_merge_is_first_visibility_and_summed_counts(spark):
    rows = [("a", "b", "include", "x", None, None, 1), ("a", "b", "include", "x", 2, "private", 2), ("a", "b", "include", "x", 3, "public", 3), ("a", "b", "link", "x", None, None, 1)]
    got = {r.type: (r["count"], r.visibility) for r in merge.merge_evidence(spark.createDataFrame(rows, ITEM)).collect()}
    assert got == {"include": (5, "private"), "link": (None, None)}


def test_scalar_fold_tracks_priority_per_key(spark):
    rows = [("t", 1, 10, "low"), ("t", 2, 100, None), ("t", 3, 50, "mid"), ("u", 1, 50, "b"), ("u", 2, 50, "a"), ("u", 3, 40, "c"), ("v", 1, 10, None)]
    got = merge.scalar_winner(spark.createDataFrame(rows, "id string, fragment int, priority int, value string")).collect()
    assert {r.id: r.value for r in got} == {"t": "low", "u": "a", "v": None}


def test_coverage_order_and_gate(spark):
    values = ["true", "9/20", "10/20", "0/5", "partial", "false", None]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, value string")
    assert [r.c for r in rows.orderBy("k").select(ev.covered(F.col("value")).alias("c")).collect()] == [True, True, True, False, False, False, False]
    best = merge.best_coverage(rows.where("k BETWEEN 1 AND 5").select(F.lit("x").alias("id"), F.lit("L0").alias("layer"), "value")).first()
    assert best.value == "10/20"


@pytest.mark.parametrize("pattern,hits", [("a*", ["ab/c", "abc"]), ("a?c", ["abc"]), ("[!a]*", ["B.c"]), ("*[bc]", ["ab/c", "abc", "B.c"]), ("B.c", ["B.c"]), ("", [])])
def test_globs(spark, pattern, hits):
    rows = spark.createDataFrame([("ab/c",), ("abc",), ("B.c",), (None,)], "x string")
    assert [r.x for r in rows.where(ids.glob(F.col("x"), pattern)).collect()] == hits


def test_identifiers(spark):
    row = spark.createDataFrame([("web::cxx:lib:a:b",)], "id string").select(
        ids.repo_of(F.col("id")).alias("repo"), ids.strip_repo(F.col("id")).alias("bare"), ids.parts(F.col("id")).alias("p"), ids.with_repo("x", F.lit("a:b:c")).alias("w"),
        ids.camel(F.lit("src/my-cool_lib")).alias("camel"), ids.is_guid(F.lit("0F-1-2-3-a")).alias("g"), ids.norm_guid(F.lit("{AB}")).alias("n"), ids.norm_lib(F.lit("LibFoo")).alias("l"),
    ).first()
    assert (row.repo, row.bare, tuple(row.p), row.w, row.camel, row.g, row.n, row.l) == ("web", "cxx:lib:a:b", ("cxx", "lib", "a:b"), "x::a:b:c", "myCoolLib", True, "ab", "foo")


def random_graph(seed, nodes=14, count=26):
    rng = random.Random(seed)
    return sorted({(f"n{rng.randrange(nodes):02}", f"n{rng.randrange(nodes):02}") for _ in range(count)})


def closure(pairs):
    nodes = {x for p in pairs for x in p}
    reach = {n: {b for a, b in pairs if a == n} for n in nodes}
    for k, a in itertools.product(nodes, nodes):
        if k in reach[a]:
            reach[a] |= reach[k]
    return reach


@pytest.mark.parametrize("seed", [1, 2])
def test_graph_operators_match_closure(spark, seed):
    pairs = random_graph(seed)
    reach = closure(pairs)
    table = edges(spark, pairs)
    scc = {}
    for a in reach:
        group = {b for b in reach[a] if a in reach[b]} | {a}
        if len(group) > 1:
            scc[a] = min(group)
    assert {r.node: r.component for r in graph.strong_components(table).collect()} == scc
    weak = closure(pairs + [(b, a) for a, b in pairs])
    got = {r.node: r.component for r in connected_components(table, "source", "target").collect()}
    assert got == {a: min(weak[a] | {a}) for a in weak if weak[a] - {a}}
    start = pairs[0][0]
    got = {r.node for r in graph.reach(table, spark.createDataFrame([(start,)], "id string")).collect()}
    assert got == reach[start] - {start}


def test_shortest_paths_on_a_diamond(spark):
    table = edges(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("a", "x")])
    assert [(r.path, r.hops) for r in graph.shortest_paths(table, "a", "e").collect()] == [("a > b > d > e", 3), ("a > c > d > e", 3)]
    assert graph.shortest_paths(table, "e", "a").count() == 0


def test_components_ignore_loops_and_nulls(spark):
    table = spark.createDataFrame([(5, 5), (None, 1), (3, 2), (2, 9)], "src long, dst long")
    assert sorted(tuple(r) for r in connected_components(table).collect()) == [(2, 2), (3, 2), (9, 2)]
    assert connected_components(table.limit(0)).count() == 0


def targets(spark, rows):
    return spark.createDataFrame(rows, "id string, name string, path string, external boolean, tags array<string>, container_id string, documented boolean")


def test_group_precedence(spark):
    table = targets(spark, [("a", "a", "lib/a", False, ["t:x"], "c", False), ("b", "b", "lib/b", False, [], "c", False), ("c", "c", "app/c", False, ["t:x"], "c", False)])
    rules = curate.Rules(groups=[curate.Group("One", members=["b"], tags=["t:*"]), curate.Group("Two", members=["b"], globs=["lib/*"])])
    got = {r.id: (r.grouped_by.signal, r.grouped_by.container) for r in curate.group(table, rules).collect()}
    assert got == {"a": ("tag", "One"), "b": ("member", "Two"), "c": ("tag", "One")}


def test_renames(spark):
    drift = spark.createDataFrame([("old/x", "removed"), ("new/x", "new"), ("other", "new")], "id string, status string")
    assert [tuple(r) for r in govern.suspected_renames(drift).collect()] == [("old/x", "new/x")]
    assert [tuple(r) for r in govern.suspected_renames(spark.createDataFrame([("p", "removed"), ("q", "new")], "id string, status string")).collect()] == [("p", "q")]


def test_cut_refuses_unknown_edges(spark):
    table = edges(spark, [("a", "b")])
    assert risk.cut_edges(table, "a", "b").count() == 0
    with pytest.raises(ValueError):
        risk.cut_edges(table, "b", "a")


def test_proposal_claims_once(spark):
    table = targets(spark, [(x, x, f"lib/{x}", False, ["plugin-type:p"] if x in "ab" else [], x, False) for x in "abcde"])
    got = {r.id: r.signal for r in propose.proposal(table, edges(spark, [("d", "e")])).collect()}
    assert got == {"a": "plugin-type", "b": "plugin-type", "c": "directory", "d": "directory", "e": "directory"}


def test_token_bindings(spark):
    humans = spark.createDataFrame([(1, ["order", "service"]), (2, ["zzz"])], "human long, tokens array<string>")
    found = spark.createDataFrame([("a", ["order", "service"]), ("b", ["order"])], "target string, tokens array<string>")
    assert [tuple(r) for r in ownership.token_bindings(humans, found).collect()] == [(1, "a", 0.85)]


def test_empty_edge_sets_agree(spark):
    none = edges(spark, [])
    some = edges(spark, [("a", "b")])
    score = lambda a, b: tuple(partition.edge_scores(a, b, ["source", "target"]).first())
    assert score(none, none) == (1.0, 1.0, 1.0, 1.0) and score(none, some) == (0.0, 0.0, 0.0, 0.0) and score(some, some) == (1.0, 1.0, 1.0, 1.0)


@pytest.mark.parametrize("shape", [(4, 4), (3, 5), (5, 3), (1, 1)])
def test_assignment_is_optimal(shape):
    rng = random.Random(str(shape))
    for _ in range(20):
        cost = [[rng.randrange(20) for _ in range(shape[1])] for _ in range(shape[0])]
        pairs = partition.assignment(cost)
        small, large = sorted(shape)
        turned = cost if shape[0] <= shape[1] else [list(c) for c in zip(*cost)]
        best = min(sum(turned[k][p[k]] for k in range(small)) for p in itertools.permutations(range(large), small))
        assert len(pairs) == small and len({c for _, c in pairs}) == small and sum(cost[r][c] for r, c in pairs) == best


def test_statistics():
    assert partition.wilson(5, 10) == (0.2366, 0.7634) and partition.wilson(0, 0) is None
    assert partition.mcnemar_exact(0, 5) == 0.0625 and partition.mcnemar_exact(0, 0) is None
    assert partition.holm({"a": 0.01, "b": 0.04, "c": 0.03}) == {"a": 0.03, "c": 0.06, "b": 0.06}
    same = {"a": "1", "b": "1", "c": "2"}
    assert partition.mojo_fm(same, same) == 100.0 and partition.mojo_fm({}, same) is None
    assert partition.mojo_fm({"a": "x", "b": "y", "c": "z"}, same) < 100


def test_line_counter_hash_and_routes():
    counted = texts.count_lines("int a; // TODO\n\n/* x\n y */ int b;\n// z\n", "c")
    assert counted == {"blank": 1, "comment": 2, "code": 2, "todo": 1}
    assert texts.content_hash({"a": 1, "provenance": {"commit": 2}}) == texts.content_hash({"a": 1, "provenance": {"commit": 3}})
    for question, route in (("which module depends on x", "dependents"), ("what does core depend on", "dependencies"), ("show dependents of x", "dependents"), ("x depends on?", "dependencies"), ("which depends", "dependents"), ("depends", "dependencies")):
        assert texts.question_route(question) == route
    assert texts.question_route("Who depends on core?") == "dependents" and texts.question_route("hello") is None
