"""The run over a source tree, side files, sinks, canonical models, and refusals."""

import re
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import sinks
from lodestone.functions import texts
from lodestone.operators import layout, mutations, partition, simulate
from lodestone.sources import build, code, files, sidecars, tree


def write(root, path, text):
    (root / path).parent.mkdir(parents=True, exist_ok=True)
    (root / path).write_text(text)


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    write(root, "All.sln", 'Project("{FAE04EC0-301F-11D3-BF4B-00C04F79EFBC}") = "App", "src\\App\\App.csproj", "{A1}"\nProject("{2150E333-8FDC-42A3-9474-1A3956D46DE8}") = "inner", "inner", "{B2}"\nProject("{2150E333-8FDC-42A3-9474-1A3956D46DE8}") = "outer", "outer", "{C3}"\nGlobal\n GlobalSection(NestedProjects) = preSolution\n {A1} = {B2}\n {B2} = {C3}\n EndGlobalSection\nEndGlobal\n')
    write(root, "src/App/App.csproj", '<Project Sdk="Microsoft.NET.Sdk.Web"><ItemGroup><ProjectReference Include="..\\Lib\\Shop.Plugin.Pay.csproj"/><PackageReference Include="Json"/></ItemGroup></Project>')
    write(root, "src/App/obj/project.assets.json", json.dumps({"targets": {"net8": {"Json/1.0": {"type": "package"}, "Deep/2.1": {"type": "package"}, "Lib/1.0": {"type": "project"}}, "bad": 3}}))
    write(root, "src/App/Interop.cs", '[DllImport("engine.dll")]\nextern void Run(); // [DllImport("no.dll")]\nvar order_pb2 = 1;')
    write(root, "src/Lib/Shop.Plugin.Pay.csproj", '<Project Sdk="Microsoft.NET.Sdk"></Project>')
    write(root, "src/Lib/Manifest.cs", '[assembly: Module(Category = "Payment")]')
    write(root, "native/Engine.vcxproj", '<Project><ConfigurationType>DynamicLibrary</ConfigurationType><ItemGroup><ProjectReference Include="..\\gone\\Gone.vcxproj"/><ClCompile Include="a.cpp"/></ItemGroup></Project>')
    write(root, "native/calc.idl", "[uuid(AAAAAAAA-1111-2222-3333-BBBBBBBBBBBB)] coclass Calc {}")
    write(root, "proto/order.proto", 'syntax = "proto3";')
    write(root, "scripts/run.py", "import order_pb2")
    write(root, "docker-compose.yml", "services:\n  web:\n    image: shop/web\n    depends_on: [db]\n  db:\n    image: host:5000/postgres:15\n")
    write(root, "k8s/app.yaml", "kind: Deployment\nmetadata: {name: api}\nspec:\n  replicas: 2\n  template: {spec: {containers: [{image: shop/api}]}}\n")
    write(root, "k8s/template.yaml", "{{- if .Values.on }}\nkind: [")
    write(root, "k8s/list.yaml", "- just\n- a list\n")
    write(root, "infra/main.tf", 'resource "aws_sqs_queue" "jobs" {}\n')
    return root


def test_model_of_a_tree(spark, root):
    found = tree.extract(spark, str(root))
    targets = {r.id: r for r in found.united().collect()}
    app, pay, engine = (targets[i] for i in ("csharp:project:src/App/App.csproj", "csharp:project:src/Lib/Shop.Plugin.Pay.csproj", "cxx:project:native/Engine.vcxproj"))
    assert app.tags == ["sdk-role:service-web", "seam:native", "slnfolder:outer"] and not app.external and app.type == "project"
    assert pay.tags == ["module-category:Payment", "plugin-type:Pay", "sdk-role:library"]
    assert (engine.type, engine.com_provides) == ("shared_lib", ["aaaaaaaa-1111-2222-3333-bbbbbbbbbbbb"])
    assert targets["cxx:project:gone/Gone.vcxproj"].type == "placeholder" and targets["boundary:native:engine.dll"].external
    assert {i for i in targets if i.startswith("csharp:package:")} == {"csharp:package:Json", "csharp:package:Deep"}
    edges = {(r.source, r.target): r for r in found.edges().collect()}
    assert set(edges) == {
        (app.id, pay.id), (app.id, "csharp:package:Json"), (app.id, "csharp:package:Deep"), (app.id, "boundary:native:engine.dll"), (app.id, "contract:proto/order.proto"), ("dir:scripts", "contract:proto/order.proto"),
        (engine.id, "cxx:project:gone/Gone.vcxproj"), ("deploy:image:web", "infra:database:db"),
    }
    assert edges[app.id, "boundary:native:engine.dll"].evidence_strength == "interop" and edges[app.id, pay.id].is_declared_dependency
    coverage = {(r.id, r.layer): r.value for r in found.coverage.collect()}
    assert coverage[app.id, "L1"] == "true" and coverage[pay.id, "L1"] == "false" and coverage[pay.id, "L0"] == "true" and coverage[app.id, "interop"] == "true"
    assert {r.id for r in found.deploy_nodes.collect()} == {"deploy:image:web", "infra:database:db", "deploy:image:api", "infra:queue:jobs"}


def test_side_files(spark, tmp_path):
    write(tmp_path, "a/obj/project.assets.json", "[]")
    write(tmp_path, "deps-1.json", json.dumps({"fileDeps": {"files": {"x.cs": "t:a", "y.cs": None, "z.cs": "t:gone"}, "edges": [["x.cs", "y.cs"], ["bad"]]}}))
    write(tmp_path, "api-1.json", json.dumps({"apiSkeleton": {"targets": {"t:a": ["A", "B"]}}}))
    write(tmp_path, "api-2.json", json.dumps({"apiSkeleton": {"targets": {"t:a": ["C"], "t:b": ["D"]}}}))
    assert files.parsed(tree.spark_files(spark, str(tmp_path), "project.assets.json"), sidecars.restored_packages, sidecars.PACKAGES).count() == 0
    deps = files.parsed(tree.spark_files(spark, str(tmp_path), "deps-*.json"), sidecars.file_dependencies, sidecars.FILE_DEPS).cache()
    assert [(r.a, r.b) for r in deps.where("kind = 'edge'").collect()] == [("x.cs", "y.cs")]
    types = sidecars.merged_types(files.parsed(tree.spark_files(spark, str(tmp_path), "api-*.json"), sidecars.api_types, sidecars.API_TYPES))
    assert {r.target: r.types for r in types.collect()} == {"t:a": ["A", "B"], "t:b": ["D"]}
    targets = spark.createDataFrame([("t:a", "c:x", False), ("t:e", "c:y", True)], "id string, container_id string, external boolean")
    lines, counts = sidecars.file_contain_lines(deps.where("kind = 'file'").select(deps.a.alias("file"), deps.b.alias("target")), targets)
    assert [r.line for r in lines.collect()] == ["contain c:x x.cs"] and tuple(counts.first()) == (1, 1)
    projects = spark.createDataFrame([("p", ["a.cpp", "b.cpp"], ["inc"], ["X=1"])], "directory string, sources array<string>, includes array<string>, defines array<string>")
    assert sorted(r.command for r in sidecars.compile_commands(projects).collect()) == ["cl.exe /Iinc /DX=1 /c a.cpp", "cl.exe /Iinc /DX=1 /c b.cpp"]
    covered = sidecars.with_packages(spark.createDataFrame([("p",), ("q",)], "project string"), spark.createDataFrame([("p", "Z"), ("p", "A")], "project string, package string"))
    assert {r.project: (r.packages, r.covered) for r in covered.collect()} == {"p": (["A", "Z"], True), "q": (None, False)}


def test_canonical_models():
    a = {"targets": [{"id": "b", "tags": ["y", "x"], "namespaces": ["n2", "n1"]}, {"id": "a", "components": ["k2", "k1"]}], "relationships": [{"source": "b", "target": "a", "evidence": [{"type": "z"}, {"type": "link", "detail": "q"}, {"type": "link"}]}], "provenance": {"commit": "1", "generated_at": "now", "tool": "t"}}
    b = {"provenance": {"tool": "t", "commit": "2", "interop_resolved": [1]}, "relationships": [{"source": "b", "target": "a", "evidence": [{"type": "link"}, {"type": "z"}, {"type": "link", "detail": "q"}]}], "targets": [a["targets"][1], {"id": "b", "namespaces": ["n1", "n2"], "tags": ["x", "y"]}]}
    assert texts.content_hash(a) == texts.content_hash(b) and a["targets"][0]["id"] == "b"
    assert texts.content_hash(a) != texts.content_hash(a | {"provenance": {"tool": "other"}})
    # The order of components means something.
    assert texts.content_hash(a) != texts.content_hash(a | {"targets": [a["targets"][0], {"id": "a", "components": ["k1", "k2"]}]})


def test_statistics_without_systems():
    values, good = {"s1": 0.9, "s2": 0.8, "s3": 0.3, "s4": 0.2}, {"s1": True, "s2": True, "s3": False, "s4": False}
    assert partition.leave_one_out(values, good) == {"s1": (0.3, 0.8), "s2": (0.3, 0.9), "s3": (0.2, 0.8), "s4": (0.3, 0.8)}
    assert layout.overlaps({"a": (0, 0), "b": (100, 0), "c": (160, 0), "d": (0, 80)}, {}) == 2


def test_drafts_views_and_reports(spark):
    rows = spark.createDataFrame([("directory", "src/a", "t:2"), ("directory", "src/a", "t:1"), ("tag", "core", "t:3")], "signal string, name string, id string")
    text = sinks.proposal_text(rows)
    assert text.startswith("# ") and "- t:1\n" in text and text.index("t:1") < text.index("t:2") and "provenance: tag" in text
    with pytest.raises(ValueError):
        sinks.proposal_text(rows, most=2)
    view = sinks.view_text([{"type": "container", "key": "all", "include": "*"}, {"type": "odd", "key": "no"}, {"type": "filtered", "key": "f", "base": "all", "mode": "exclude", "exclude": ["x", "y"]}])
    assert view == '// Made from view intents.\ncontainer system "all" {\n  include *\n  autoLayout\n}\nfiltered "all" exclude "x,y" "f"\n'

    def failing(event):
        raise OSError("gone")

    events: list = []
    report = sinks.RunReport(sink=events.append)
    with pytest.raises(KeyError), report.stage("extract"):
        with report.stage("extract", "files"):
            pass
        raise KeyError
    assert [(e["event"], e["step"]) for e in events] == [("start", None), ("start", "files"), ("finish", "files"), ("finish", None)]
    assert set(report.stages) == {"extract"} and set(report.steps["extract"]) == {"files"}
    quiet = sinks.RunReport(sink=failing)
    with quiet.stage("x"):
        pass
    assert len(quiet.notes) == 2 and json.loads(quiet.text())["notes"] == quiet.notes


def test_refusals(spark):
    assert simulate.migrate("1.4") == "1.4"
    for version in ("2.0", "", "1.x"):
        with pytest.raises(ValueError):
            simulate.migrate(version)
    targets = spark.createDataFrame([("t:a", "c:x", "a secret Name")], "id string, container_id string, name string")
    with pytest.raises(ValueError):
        simulate.move(targets, ["t:a"], "c:none")
    with pytest.raises(ValueError):
        simulate.extract(targets, ["t:none"], "c:new")
    with pytest.raises(ValueError):
        mutations.allowed_payloads(targets.select("id", "name"), ["SECRET"])
    assert mutations.allowed_payloads(mutations.element_payload(targets, ["name"], ["[Ss]ecret"], ["Name"]), ["secret"]).first().name == "a [redacted] [redacted]"


@pytest.mark.parametrize("family", sorted(texts.COMMENTS))
def test_lines_by_fold_and_by_hand(spark, family):
    rng = np.random.default_rng(5)
    marks = [m for m in texts.COMMENTS[family] if m]
    rows = [(k, "".join(rng.choice([*marks, *marks, "x", " ", "\n", "\n", "\t", "TODO", "\r\n", "é"], int(rng.integers(0, 30))))) for k in range(300)]
    rows += [(-1, None), (-2, ""), (-3, "\n"), (-4, "a\n\nb"), (-5, "x\u2028y\u0085z")]
    found = spark.createDataFrame(rows, "id long, text string").select("id", texts.line_counts(F.col("text"), family).alias("c")).select("id", "c.*").collect()
    want = {i: texts.count_lines(t or "", family) for i, t in rows}
    assert {r.id: {n: r[n] for n in ("blank", "comment", "code", "todo")} for r in found} == want


def test_names_of_elements_and_texts(spark):
    ids = ["csharp:csproj:src/Web/Toy.Web.csproj", "container:webFrontend", "ControlApp::csharp:csproj:src/Web/Toy.Web.csproj", "cxx:lib:7zip", "x:y:", "::", "..."]
    got = {r.id: r.name for r in spark.createDataFrame([(i,) for i in ids], "id string").select("id", texts.element_name(F.col("id")).alias("name")).collect()}
    assert [got[i] for i in ids] == ["toyWeb", "webFrontend", "controlAppToyWeb", "e7zip", "y", "e", "e"]
    names = {r.id: r.name for r in texts.unique_names(spark.createDataFrame([("a:lib:Core",), ("b:lib:core",), ("a:lib:Core",), (None,)], "id string")).collect()}
    assert names["a:lib:Core"] == "core" and re.fullmatch("core_[0-9a-f]{6}", names["b:lib:core"]) and len(names) == 2
    rows = spark.createDataFrame([(1, [" ", None]), (2, ["", "x"]), (3, None), (4, [])], "id int, r array<string>")
    assert {r.id for r in rows.where(texts.has_text(F.col("r"))).collect()} == {2}


def test_activation_by_class_and_roots():
    found = {(k, n) for _, k, n, _ in code.interop("a.cs", 'Type.GetTypeFromCLSID(new Guid("{AAAAAAAA-0000-0000-0000-000000000000}")); Type.GetTypeFromProgID("P.Q");')}
    assert found == {("com", "aaaaaaaa-0000-0000-0000-000000000000"), ("com", "P.Q")}
    assert [n for _, _, n, _ in code.interop("a.cpp", "CoCreateInstance(CLSID_Calc, 0, 1, IID_ICalc, &p);")] == ["Calc"]
    assert not list(code.interop("b.cpp", "const GUID CLSID_Calc;"))
    text = '<Project><ItemGroup><ProjectReference Include="$(SolutionDir)lib\\L.csproj"/><ProjectReference Include="$(Other)x.csproj"/></ItemGroup></Project>'
    assert list(build.project_refs("src/a/A.csproj", text)) == [("src/a/A.csproj", "project_ref", "lib/L.csproj")]
