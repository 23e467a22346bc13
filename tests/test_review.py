"""Names, bindings, findings, rule files and partition measures on small inputs."""

from pyspark.sql import functions as F

from lodestone import config
from lodestone.operators import baseline, findings, merge, naming, partition

RULES = """
defaults: {min_relationship_weight: 5, drop_external: false}
exclude: {targets: [{glob: 'test/*'}, {id: x}]}
group: [{container: Core, members_glob: 'lib/*', members: [a]}, {container: Ui, members_tag: ['t:*', 'u:*']}]
relationship_kinds: [{when_evidence_contains: http, kind: rest}]
"""


def test_rule_files(spark, tmp_path):
    rules = config.mapping_rules(RULES)
    assert (rules.min_weight, rules.drop_external, rules.down_weight_private, rules.exclude, rules.exclude_ids) == (5, False, True, ["test/*"], ["x"])
    assert [(g.container, g.members, g.globs, g.tags) for g in rules.groups] == [("Core", ["a"], ["lib/*"], []), ("Ui", [], [], ["t:*", "u:*"])]
    assert config.mapping_rules(None).min_weight == 3
    assert [tuple(r) for r in config.layering_rules(spark, "forbidden: [{from: a, to: b}]").collect()] == [("a -> b", "a", "b")]
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.txt").write_text("1")
    before = config.input_key(spark, str(tmp_path / "src"), "*.txt", "1")
    assert before == config.input_key(spark, str(tmp_path / "src"), "*.txt", "1") != config.input_key(spark, str(tmp_path / "src"), "*.txt", "2")
    (tmp_path / "src/a.txt").write_text("2")
    assert before != config.input_key(spark, str(tmp_path / "src"), "*.txt", "1")
    built = []

    def build():
        built.append(1)
        return spark.range(2)

    assert [config.cached(spark, str(tmp_path / "cache"), before, build).count() for _ in range(2)] == [2, 2] and built == [1]


def test_names(spark):
    siblings = spark.createDataFrame([("n:lib:src/a/util", "util"), ("n:lib:src/b/util", "util"), ("n:lib:c", "other"), ("n:lib:d", "x")], "id string, name string")
    got = {r.id: r.name for r in naming.unique_names(siblings, spark.createDataFrame([("n:lib:d", "other")], "id string, name string")).collect()}
    assert got == {"n:lib:src/a/util": "util (a)", "n:lib:src/b/util": "util (b)", "n:lib:c": "other (lib)", "n:lib:d": "other"}
    styled = spark.createDataFrame([("g", "1", "a_b"), ("g", "2", "c_d"), ("g", "3", "eF"), ("h", "4", "gH")], "g string, id string, name string")
    assert [r.id for r in naming.outliers(styled, "g").collect()] == ["3"]
    targets = [{"id": "n:a1", "path": "p/x", "name": "q"}, {"id": "n:a2", "path": "p/y", "name": "q2"}, {"id": "n:b", "path": "r", "name": "z"}]
    assert naming.tightest_glob(["n:a1", "n:a2"], targets) == "n:a*" and naming.tightest_glob(["n:a1", "n:b"], targets) is None
    row = spark.range(1).select(naming.edge_tags(F.lit("rest"), F.array(F.lit("link")), F.lit(True), F.lit("high"), F.lit(None).cast("array<string>")).alias("t"), naming.normal_label(F.lit(" A_b-C ")).alias("l"), naming.boundary_member(F.lit(None).cast("boolean"), F.array(F.lit("person"))).alias("b")).first()
    assert (row.t, row.l, row.b) == (["confidence:high", "declared", "kind:rest", "link"], "a b c", True)


def test_reconciliation(spark):
    bindings = spark.createDataFrame([("h1", "t1", "confirmed", "high"), ("h2", "t1", "confirmed", "high"), ("h3", "gone", "confirmed", "low"), ("h4", "t2", "proposed", "medium")], "human_id string, extracted_id string, status string, confidence string")
    won, lost = baseline.rekeyed(bindings)
    assert {r.human_id for r in won.collect()} == {"h1", "h3"} and [r.human_id for r in lost.collect()] == ["h2"]
    assert baseline.accept(bindings, "medium").where("status = 'confirmed'").count() == 4 and baseline.accept(bindings, "high").where("status = 'confirmed'").count() == 3
    elements, targets = spark.createDataFrame([("h1",), ("h3",), ("h4",)], "human_id string"), spark.createDataFrame([("t1",), ("t2",)], "id string")
    assert {r.id: r.status for r in baseline.reconcile(elements, targets, bindings).collect()} == {"h1": "matched", "h3": "missing-in-code", "h4": "unbound", "t2": "not-in-model"}
    a = spark.createDataFrame([("x", "1"), ("y", "1"), ("z", "2")], "id string, container_id string")
    b = spark.createDataFrame([("x", "1"), ("y", "2"), ("w", "2")], "id string, container_id string")
    assert {r.id for r in baseline.regrouped(a, b).collect()} == {"y", "z", "w"}
    delta = baseline.metric_delta(spark.createDataFrame([(1, 2)], "n int, m int"), spark.createDataFrame([(4, 2)], "n int, m int"))
    assert {r.metric: r.delta for r in delta.collect()} == {"n": 3.0, "m": 0.0}
    cells = spark.createDataFrame([("a", "x", 2), ("b", "y", 1), ("b", "z", 1), ("c", "w", 3), ("d", "w", 1)], "a string, b string, n long")
    assert {r.relation: r.entities for r in baseline.partition_relation(cells).collect()} == {"same": 2, "split": 2, "merged": 4}
    scores = spark.createDataFrame([("s1", "p", 2.0), ("s1", "q", 1.0), ("s2", "p", 1.0), ("s2", "q", 1.0)], "system string, technique string, value double")
    assert tuple(baseline.win_count(scores, "p").first()) == (1, 2) and tuple(baseline.win_count(scores, "p", strict=False).first()) == (2, 2)
    ranks, difference, n = partition.critical_difference(scores)
    assert {r.technique: r["rank"] for r in ranks.collect()} == {"p": 1.25, "q": 1.75} and n == 2 and round(difference, 2) == 1.39


def test_findings(spark):
    items = spark.createDataFrame([("a", "b", "interop", "d", None, None), ("c", "b", "interop", "d", None, None), ("b", "a", "include", "d", 1, None), ("c", "a", "interop", "d", None, None)], "source string, target string, type string, detail string, count long, visibility string")
    edges = merge.edges_of(items)
    targets = spark.createDataFrame([("a", "ATests", "A", []), ("b", "b", "B", []), ("x", "x", "B", []), ("c", "c", "C", ["test"])], "id string, name string, container_id string, tags array<string>")
    assert tuple(findings.dominant_seam(edges, targets).first()) == ("C", 2, 3)
    found = findings.report({"hub": spark.createDataFrame([("e1", 0.5)], "element string, severity double"), "cycle": spark.createDataFrame([("e2", 0.9), ("e3", 0.5)], "element string, severity double")}, top=2)
    assert [(r.kind, r.element, r.total) for r in found.collect()] == [("cycle", "e2", 3), ("cycle", "e3", 3)]
    components = spark.createDataFrame([("a", "a"), ("b", "a")], "node string, component string")
    assert [tuple(r) for r in findings.weakest_cycle_edges(edges, components).collect()] == [("a", "b", "a", 1)]
    assert [tuple(r) for r in findings.busiest_members(edges, targets).collect()] == [("B", "b", 2)]
    assert {r.container_id: r.tests for r in findings.tested_by(edges, targets).collect()} == {"A": 1, "B": 2}
    types = spark.createDataFrame([("A", "IRepository"), ("A", "Repository"), ("B", "BaseRepository"), ("B", "Factory")], "container_id string, text string")
    assert {(r.pattern, r.container_id, r.n) for r in findings.pattern_counts(types, [("repository", "Repository"), ("factory", "Factory")]).collect()} == {("repository", "A", 2), ("repository", "B", 1)}
    members = spark.createDataFrame([("README.md", 5), ("main.c", 5), ("u.h", 5), ("v.c", 5)], "path string, size long")
    links = spark.createDataFrame([("main.c", "u.h"), ("v.c", "u.h"), ("v.c", "zz.h")], "src string, dst string")
    assert {(r.why, r.path) for r in findings.anchors(members, links).collect()} == {("readme", "README.md"), ("entry", "main.c"), ("central", "u.h")}
    scores = spark.createDataFrame([("k", "i", 0.3), ("k", "j", 0.1), ("k", "l", 0.2)], "container_id string, id string, score double")
    assert [(r.id, r["rank"]) for r in findings.weakest_members(scores).orderBy("rank").collect()] == [("j", 1), ("l", 2)]


def test_partition_measures():
    a = {"x": "1", "y": "1", "z": "2"}
    assert partition.a2a(a, a) == 100.0 and partition.a2a({}, {}) == 100.0 and 0 <= partition.a2a(a, {"q": "1"}) < partition.a2a(a, {"x": "1", "y": "2", "z": "2"}) < 100
    nodes = {"x", "y"}
    assert partition.parse_partition('text {"x": "A", "y": "B", "q": "C"} more', nodes) == {"x": "A", "y": "B"}
    assert partition.parse_partition('{"A": ["x", "q"], "B": ["y"]}', nodes) == {"x": "A", "y": "B"}
    assert partition.parse_partition('[{"name": "A", "members": ["x"]}, {"members": ["y"]}]', nodes) == {"x": "A", "y": "1"}
    assert partition.parse_partition("nothing", nodes) == {} == partition.parse_partition("{broken", nodes)


def test_later_additions(spark):
    from lodestone.operators import lift, propose
    from lodestone.sources import code

    table = spark.createDataFrame([("a", False, [], "p", ["N::x"]), ("b", False, [], "q", ["N.y"]), ("c", False, [], "r", []), ("d", False, [], "s", ["M"])], "id string, external boolean, tags array<string>, path string, namespaces array<string>")
    assert {(r.name, r.id) for r in propose.by_namespace(table).collect()} == {("N", "a"), ("N", "b")}
    assert list(code.hosted_services("h.cs", "x.AddHostedService<My.Worker>(); // AddHostedService<No>")) == [("h.cs", "Worker")]
    kinds = spark.createDataFrame([("docs/adr/1.md",), ("a/Dockerfile",), ("x.sln",), ("m.dsl",), ("z.c",)], "p string").select(code.artifact_kind(F.col("p")).alias("k"))
    assert [r.k for r in kinds.collect()] == ["decision", "deployment", "build", "model", None]
    nodes, edges = spark.createDataFrame([("a",)], "id string"), spark.createDataFrame([("a", "b")], "source string, target string")
    more, drawn = code.overlaid(nodes, edges, spark.createDataFrame([("a",), ("b",)], "id string"), edges.where("source = 'z'"))
    assert more.count() == 2 and drawn.count() == 1
    model = spark.createDataFrame([("a", "A", "Foo"), ("b", "A", "Bar"), ("c", "C", "bar"), ("d", "C", "x")], "id string, container_id string, name string")
    links = spark.createDataFrame([("a", "b", 1), ("a", "c", 2), ("a", "d", 3), ("c", "b", 4)], "source string, target string, weight long")
    assert {(r.source, r.target, r.weight) for r in lift.drilldown(links, model, "A").collect()} == {("a", "b", 1), ("a", "C", 5), ("C", "b", 4)}
    assert lift.induced(links, model.where("id <> 'd'")).count() == 3 and {r.label for r in lift.unique_labels(model).collect()} == {"foo", "x"}
    found = spark.createDataFrame([("hub", "a", 0.5, "h1"), ("hub", "b", 0.5, "h0")], "kind string, element string, severity double, model_hash string")
    assert [r.element for r in findings.echoed(found, model, ["h1"]).collect()] == ["a"]
    sizes = spark.createDataFrame([("a", 5, "h1"), ("b", 6, "h0")], "id string, size long, model_hash string")
    assert [tuple(r) for r in findings.footprint(sizes, model, "h1").collect()] == [("A", 11, True)]
    families = spark.createDataFrame([("x", str(k)) for k in range(9)] + [("y", "1")], "category string, family string")
    assert {r.category: r.cap for r in findings.category_budget(families, 16, 4).collect()} == {"x": 5, "y": 3}
    parts = spark.createDataFrame([("e1", "1"), ("e2", "1"), ("e3", "2"), ("e 4", "2")], "entity string, label string")
    got = partition.comparison({"same": parts, "less": parts.where("entity <> 'e3'")}, parts).collect()
    assert {r.technique: (r.n, r.ari) for r in got} == {"same": (2, 100.0), "less": (2, 100.0)}
    assert partition.churn_stability({"x": "1", "y": "1", "z": "2"}, {"x": "7", "y": "7"}) == 100.0
    assert partition.separating_interval({"a": 1, "b": 3}, {"a": False, "b": True}) == (1, 3) and partition.separating_interval({"a": 4, "b": 3}, {"a": False, "b": True}) is None
    low, high = partition.bootstrap_rho([1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 6, 5])
    assert 0 < low <= high <= 1 and partition.bootstrap_rho([1], [1]) is None
