"""The query façade, scenarios, decisions, boundaries, layout and clusterings on small models."""

import pytest

from lodestone.operators import clusterings, decisions, interop, layout, merge, ranking, scenarios
from lodestone.operators.query import Model

ITEM = "source string, target string, type string, detail string, count long, visibility string"


@pytest.fixture(scope="module")
def model(spark):
    names = [("t:a", "Alpha", "c:1"), ("t:b", "Beta", "c:1"), ("t:c", "Gamma", "c:2"), ("t:d", "Delta", "c:3"), ("t:x", "delta", "c:3")]
    targets = spark.createDataFrame([(i, n, None, False, [], c, False) for i, n, c in names], "id string, name string, path string, external boolean, tags array<string>, container_id string, documented boolean")
    items = spark.createDataFrame([(a, b, "include", a + b, n, None) for a, b, n in [("t:a", "t:c", 4), ("t:b", "t:c", 2), ("t:c", "t:d", 3), ("t:d", "t:a", 1), ("t:a", "t:b", 9)]], ITEM)
    coverage = spark.createDataFrame([("t:a", "L0", "true"), ("t:b", "L0", "partial"), ("t:c", "L0", "false")], "id string, layer string, value string")
    rules = spark.createDataFrame([("r", "c:1", "t:c")], "rule string, from string, to string")
    return Model(targets, merge.edges_of(items), coverage, rules)


def rows(answer, *columns):
    return [tuple(r) for r in answer.rows.select(*columns).collect()]


def test_resolution_cascade(model):
    assert model.resolve("t:a") == ("target", ["t:a"], []) and model.resolve("c:1") == ("container", ["t:a", "t:b"], [])
    assert model.resolve("Delta") == ("target", ["t:d"], []) and model.resolve("gamma") == ("target", ["t:c"], [])
    assert model.resolve("DELTA") == ("unknown", [], ["t:d", "t:x"]) and model.resolve("mm") == ("unknown", [], ["t:c"]) and model.resolve("") == ("unknown", [], [])


def test_primitives(model):
    assert rows(model.dependents("t:c"), "node", "weight") == [("t:a", 4), ("t:b", 2)]
    assert rows(model.dependents("c:1"), "node") == [("t:d",)]
    assert rows(model.dependencies("t:b", transitive=True), "node", "depth") == [("t:c", 1), ("t:d", 2), ("t:a", 3)]
    limited = model.dependents("t:c", limit=1)
    assert (limited.total, limited.truncated, limited.rows.count()) == (2, True, 1)
    assert rows(model.paths_between("c:1", "t:d"), "path", "hops") == [("t:a > t:c > t:d", 2), ("t:b > t:c > t:d", 2)]
    assert rows(model.paths_between("c:1", "t:a"), "path", "hops") == [("t:a", 0)]
    assert {r[0] for r in rows(model.cycles_of("t:b"), "altitude")} == {"target", "container"}
    assert rows(model.conformance_of("t:a", "t:c"), "rule", "weight") == [("r", 4)]
    assert rows(model.explain_of("t:a"), "side", "other") == [("in", "t:d"), ("out", "t:b"), ("out", "t:c")]
    assert {r[0] for r in rows(model.blast_radius("t:b"), "direction")} == {"dependents", "dependencies"}
    unknown = model.dependents("nope")
    assert unknown.error == "unknown_element" and unknown.rows is None
    assert abs(unknown.coverage - 2 / 5) < 1e-9 and unknown.advisory
    with pytest.raises(ValueError):
        model.dispatch("paths_between", "t:a")


def test_questions(model):
    assert rows(model.ask("Who depends on Gamma?"), "node") == [("t:a",), ("t:b",)]
    assert rows(model.ask("Is there a path between t:b and t:d?"), "hops") == [(2,)]
    assert model.ask("hello Gamma").error == "not_understood"


def lifted(spark, pairs):
    return spark.createDataFrame([(a, b, 1) for a, b in pairs], "source_container string, target_container string, weight long")


def test_walks_differ_on_a_diamond(spark):
    calls = lifted(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")])
    entries = spark.createDataFrame([("a",)], "container_id string")
    assert sorted((r["from"], r.to) for r in scenarios.walk(calls, entries).collect()) == [("a", "b"), ("a", "c"), ("b", "d")]
    got = sorted((r.order, r["from"], r.to) for r in scenarios.runtime_walk(calls).collect())
    assert got == [(1, "a", "b"), (1, "a", "c"), (2, "b", "d"), (2, "c", "d")]


def test_dynamic_view(spark, model):
    steps = spark.createDataFrame([("s", 1, "c:1", "Gamma"), ("s", 2, "Gamma", "t:d"), ("s", 3, "nobody", "c:1"), ("s", 4, "c:3", "c:2")], "key string, index int, from string, to string")
    view = scenarios.dynamic_view(steps, model.targets, lifted(spark, [("c:1", "c:2")]), lifted(spark, [("c:1", "c:2"), ("c:2", "c:3")]))
    assert {r["index"]: (r.status, r.evidence_layer, r.weight) for r in view.collect()} == {1: ("ok", "build", 1), 2: ("ok", "runtime", None), 3: ("unresolved", None, None), 4: ("unevidenced", None, None)}


def test_collapsed_hops(spark):
    calls = spark.createDataFrame([("t", k, c) for k, c in enumerate("aabbca")], "key string, position int, container_id string")
    assert sorted((r["from"], r.to) for r in scenarios.collapsed_hops(calls, lifted(spark, [("a", "b"), ("c", "a")])).collect()) == [("a", "b"), ("c", "a")]


def test_constraints_and_links(spark, model):
    records = spark.createDataFrame([("1", "Web must not call Data", "Hello. The **web** must not call data! Core shall not depend on UI."), ("2", "Use Gamma service", None)], "id string, title string, body string")
    got = sorted((r["from"], r.to, r.source) for r in decisions.constraints(records).where("id = '1'").collect())
    assert ("Web", "Data", "title") in got and ("Core", "UI", "body") in got
    assert [tuple(r) for r in decisions.title_links(records, model.targets).collect()] == [("t:c", "2")]
    assert decisions.mentions("we decided that the Web tier", ["Web tier", "tier"], "from") == "Web tier"
    assert decisions.evidence_hash([{"a": 1}, {"b": 2}]) == decisions.evidence_hash([{"b": 2}, {"a": 1}])


def test_inbox_and_fuse(spark):
    schema = "slug string, kind string, category string, elements string, evidence_hash string, salience int"
    detected = spark.createDataFrame([("d", "hub", "x", "a,b", "h1", 5)], schema)
    mined = spark.createDataFrame([("m1", "hub", "x", "a,b", "h2", 9), ("m2", "spof", "x", "c", "h3", 7), ("m3", "spof", "y", "d", "h4", 8)], schema)
    promoted, dismissed = spark.createDataFrame([("m3",)], "slug string"), spark.createDataFrame([("m2", "old")], "slug string, evidence_hash string")
    assert [r.slug for r in decisions.inbox(detected, mined, promoted, dismissed, 10).collect()] == ["m2", "d"]
    rich = spark.createDataFrame([("p", "x", ["b"], ["e1"], 2), ("q", "y", ["a", "b"], ["e1", "e2"], 3)], "slug string, category string, elements array<string>, evidence array<string>, weight long")
    assert tuple(decisions.fuse(rich, ["p", "q"]).first()) == (["a", "b"], ["e1", "e2"], 5, None)


def test_boundaries(spark):
    targets = spark.createDataFrame([("t1", "shared_lib", "libfoo", ["{0A-1-2-3-b}"]), ("t2", "static_lib", "foo", []), ("t3", "static_lib", "bar", ["Prog.Id"]), ("b1", "boundary", "zz", [])], "id string, type string, name string, com_provides array<string>")
    native = spark.createDataFrame([("b1", "Foo.dll"), ("b2", "bar"), ("b3", "none")], "id string, name string")
    assert {r.boundary: r.target for r in interop.resolve_native(native, targets).collect()} == {"b1": "t1", "b2": "t3"}
    com = spark.createDataFrame([("b4", "0a-1-2-3-B"), ("b5", "prog.id"), ("b6", "x")], "id string, name string")
    assert {r.boundary: r.target for r in interop.resolve_com(com, targets).collect()} == {"b4": "t1", "b5": "t3"}
    assert {r.boundary: r.target for r in interop.resolve_managed(native, targets).collect()} == {"b2": "t3"}
    items = spark.createDataFrame([("a", "b1", "interop", "d", None, None, 1), ("t1", "b1", "interop", "d", None, None, 1), ("dir:src/x/y", "k", "include", "z", 1, None, 1), ("dir:none", "k", "include", "z", 1, None, 1)], ITEM + ", fragment int")
    kept, moved = interop.rewrite(items, targets, spark.createDataFrame([("b1", "t1")], "boundary string, target string"))
    assert kept.count() == 3 and ("a", "t1") in {(r.source, r.target) for r in moved.collect()} and not moved.where("source = 't1'").count()
    owners = spark.createDataFrame([("o1", "src"), ("o2", "src/x")], "id string, path string")
    assert {r.source for r in interop.rebind_directories(items, owners).where("type = 'include'").collect()} == {"o2"}


def test_layout():
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("x", "y")]
    back = layout.feedback_arcs(list("abcdxy"), pairs)
    left = {(b, a) if (a, b) in back else (a, b) for a, b in pairs}
    depth = layout.layers(list("abcdxy"), pairs)
    assert len(back) == 1 and all(depth[a] < depth[b] for a, b in left)
    place, crossings = layout.layout(list("abcd"), [("a", "c"), ("b", "d")])
    assert crossings == 0 and len(set(place.values())) == 4
    assert layout.tour([("a", "b", 5), ("a", "c", 5), ("b", "z", 1), ("z", "q", 1)], "a", {"z"}) == ["a", "b", "z"]


def test_clusterings(spark):
    nodes = spark.createDataFrame([("src/a/x.c",), ("src/a/y.c",), ("top.c",)], "entity string")
    assert {r.entity: r.label for r in clusterings.by_leaf(nodes).collect()} == {"src/a/x.c": "src/a", "src/a/y.c": "src/a", "top.c": "."}
    assert {r.label for r in clusterings.by_top(nodes, 1).collect()} == {"src", "."}
    names = spark.createDataFrame([("Co.Web.Api",), ("Co.Web.Ui",), ("Co.Data.Db",), ("Co.Data",)], "entity string")
    assert {r.entity: r.label for r in clusterings.by_name(names).collect()} == {"Co.Web.Api": "Web", "Co.Web.Ui": "Web", "Co.Data.Db": "Data", "Co.Data": "Data"}
    assert {r.label for r in clusterings.peeled(names).collect()} == {"Web", "Data"}
    assert [r.entity for r in clusterings.removed(names, 2).orderBy("entity").collect()] == ["Co.Data", "Co.Web.Api"]
    assert [r.entity for r in ranking.spread(names, 2, ["entity"]).orderBy("entity").collect()] == ["Co.Data", "Co.Web.Api"]


def test_detection(spark):
    found = lambda rows: spark.createDataFrame(rows, "kind string, key string")
    assert tuple(clusterings.detection(found([("n", "a"), ("n", "b")]), found([("n", "b"), ("n", "c")]), ["kind", "key"]).first()) == (1, 1, 1)
    got = clusterings.classified(found([("n", "a"), ("n", "b"), ("n", "c")]), found([("n", "a")]), found([("n", "b")]), False).collect()
    assert {r.key: r.outcome for r in got} == {"a": "drift", "b": "gap", "c": "silent"}
