"""Readers of source text, sinks and streams on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone import sinks
from lodestone.sources import code
from lodestone.streaming import events

SF = "/root/testdata/sf0.001"


def test_interop_ignores_comments():
    text = '// [DllImport("no.dll")]\n[DllImport("yes.dll")]\nstring s = "[DllImport(\\"no2.dll\\")]";\n[ComImport, Guid("0000000A-0000-0000-0000-00000000000B")] class C {}\nType.GetTypeFromProgID("A.B");'
    assert [(k, n) for _, k, n, _ in code.interop("a.cs", text)] == [("native", "yes.dll"), ("com", "0000000a-0000-0000-0000-00000000000b"), ("com", "A.B")]
    assert [(k, n) for _, k, n, _ in code.interop("a.cpp", '#import <x.tlb>\n#using "M.dll"\n/* #import <y.tlb> */')] == [("typelib", "x.tlb"), ("managed", "M")]


def test_names_and_presets():
    assert code.strip_templates("a::b<c<d>, e>::f") == "a::b::f" and code.namespace_of("a::b::f") == "a::b" and code.namespace_of("f") is None
    assert code.common_directory(["a/b/c.c", "a/b/d/e.c"]) == "a/b" and code.common_directory([]) == ""
    found = code.presets({"configurePresets": [{"name": "base", "dir": "x"}, {"name": "p", "inherits": ["loop", "base"]}, {"name": "loop", "inherits": "p"}]}, {"configurePresets": [{"name": "base", "dir": "y"}]})
    assert code.preset_field(found, "p", "dir") == "y" and code.preset_field(found, "p", "none") is None


def test_small_parsers():
    xml = '<d><compounddef kind="file"><compoundname>a.h</compoundname><includes local="yes">b.h</includes><location file="a.h"/></compounddef><compounddef kind="class"><compoundname>n::C&lt; T &gt;</compoundname></compounddef></d>'
    assert list(code.doxygen("x", xml)) == [("x", "include", "a.h", "b.h", "yes"), ("x", "class", None, "n::C", "n")]
    reply = json.dumps({"id": "t1", "name": "t", "type": "EXECUTABLE", "sources": [{"path": "s/a.c"}, {"path": "s/g.c", "isGenerated": True}], "dependencies": [{"id": "t1"}, {"id": "t2"}]})
    assert [(r[1], r[5]) for r in code.file_api("r", reply)] == [("target", "s"), ("source", "s/a.c"), ("source", "s/g.c"), ("dependency", "t2")]
    assert [r[1] for r in code.compiler_calls("l", 'x\\cl.exe /c /O2 a.cpp "b c.cc"')] == ["a.cpp", "b c.cc"]
    host = 'var db = builder.AddPostgres("db"); var api = builder.AddProject<P>("api").WithReference(db).WithReference(gone).WithEnvironment("K", "v");'
    assert list(code.app_host("p", host)) == [("p", "node", "db", "Postgres"), ("p", "node", "api", "Project"), ("p", "calls", "api", "db"), ("p", "runtime_config", "api", "K")]
    assert list(code.decision_record("adr/0007-x.md", "# 7. Use X\n\n## Status\n\nAccepted\n")) == [("adr/0007-x.md", "0007", "Use X", "accepted")]


def test_tables_of_code(spark):
    names = spark.createDataFrame([("Co.Plugins.Pay.X",), ("Co.Web",)], "n string").select(code.plugin_type(F.col("n")).alias("t"))
    assert [r.t for r in names.collect()] == ["Pay", None]
    manifest = spark.createDataFrame([("m", 'Category = "B" Category="A" Category = "A" x'), ("n", 'Category="B" Category="A"')], "path string, text string")
    assert {r.path: r.category for r in code.primary_category(manifest).collect()} == {"m": "A", "n": "B"}
    sources = spark.createDataFrame([("a.cc", '#include "gen/order.pb.h"'), ("b.py", "import order_pb2"), ("c.cc", "orders")], "path string, text string")
    assert sorted(r.path for r in code.contract_references(sources, spark.createDataFrame([("api/order.proto",)], "path string")).collect()) == ["a.cc", "b.py"]
    owners, links = code.merged_sidecars(spark.createDataFrame([("1", "f", None), ("2", "f", "b"), ("3", "f", "a")], "sidecar string, file string, owner string"), spark.createDataFrame([("f", "f"), ("f", "g"), ("f", "g")], "src string, dst string"))
    assert tuple(owners.first()) == ("f", "b", True) and links.count() == 1
    places = spark.createDataFrame([("src", "S", False), ("src/a", "A", False), ("src/a/x.c", "X", True)], "key string, owner string, exact boolean")
    got = code.owner_of(spark.createDataFrame([("src/a/x.c",), ("src/a/y.c",), ("src/b.c",), ("z.c",)], "path string"), places)
    assert {r.path: r.owner for r in got.collect()} == {"src/a/x.c": "X", "src/a/y.c": "A", "src/b.c": "S"}


def test_sinks(spark, tmp_path):
    targets = spark.createDataFrame([("a", False, "container:x"), ("b", False, "container:y"), ("e", True, "container:y")], "id string, external boolean, container_id string")
    edges = spark.createDataFrame([("a", "b"), ("a", "e"), ("b", "b")], "source string, target string")
    sinks.write_graph(edges, targets, str(tmp_path / "g"))
    assert [r.value for r in spark.read.text(str(tmp_path / "g/graph")).collect()] == ["depend a b"]
    assert spark.read.json(str(tmp_path / "g/provenance")).first().asDict() == {"edges": 3, "external": 1, "loops": 1, "targets": 3}
    first = sinks.write_answer(edges, "dependents", {"id": "a"}, "h", str(tmp_path))
    assert first == sinks.write_answer(edges, "dependents", {"id": "a"}, "h", str(tmp_path)) != sinks.write_answer(edges, "dependents", {"id": "b"}, "h", str(tmp_path))
    trace = str(tmp_path / "trace")
    sinks.record(spark, trace, "opened", "2024-01-01", user="é")
    sinks.record(spark, trace, "closed", "2024-01-02")
    (tmp_path / "trace/part-bad.txt").write_text("{broken\n")
    assert sorted(r.event for r in sinks.read_trace(spark, trace).collect()) == ["closed", "opened"]
    containers = spark.createDataFrame([("container:x", False), ("container:y", True)], "container_id string, boundary boolean")
    lifted = spark.createDataFrame([("container:x", "container:y", 4, True)], "source_container string, target_container string, weight long, is_declared boolean")
    assert sinks.diagram(containers, lifted) == 'x = container "x" { tags "internal" }\ny = container "y" { tags "external" }\nx -> y "declared" { tags "weight:4" }\n'
    with pytest.raises(ValueError):
        sinks.diagram(containers, lifted, most=1)
    assert sinks.intent_warnings([{"key": "k", "type": "filtered", "base": "z"}, {"type": "odd", "include": ["*"]}], 1, 2) == ["k: undefined base", "k: nothing included", "#1: no key", "#1: unknown type", "2 containers over the budget of 1"]


def test_streams_equal_batches(spark, tmp_path):
    source = spark.read.parquet(f"{SF}/events.parquet")
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = events.event_stream(spark, str(tmp_path / "in"))
    day = events.windowed(stream, late="90 days").writeStream.outputMode("complete").format("memory").queryName("days").trigger(availableNow=True).start()
    day.awaitTermination()
    want = {(str(r.d), r.event_type): r.n for r in source.groupBy(F.to_date("ts").alias("d"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert {(str(r.start.date()), r.event_type): r.n for r in spark.table("days").collect()} == want
    users = events.running_touch(stream).writeStream.outputMode("update").format("memory").queryName("users").trigger(availableNow=True).start()
    users.awaitTermination()
    most = {r.user_id: r.n for r in spark.table("users").groupBy("user_id").agg(F.max("n").alias("n")).collect()}
    assert most == {r.user_id: r["count"] for r in source.groupBy("user_id").count().collect()}
