"""Readers of build and deployment descriptions on small source trees."""

from lodestone.sources import build, deploy, files, rsf, tree

SOLUTION = '''
Project("{FAE04EC0-301F-11D3-BF4B-00C04F79EFBC}") = "App", "src\\App\\App.csproj", "{A1}"
EndProject
Project("{2150E333-8FDC-42A3-9474-1A3956D46DE8}") = "src", "src", "{B2}"
EndProject
Global
 GlobalSection(NestedProjects) = preSolution
  {A1} = {B2}
 EndGlobalSection
EndGlobal
'''


def test_csharp_tree(spark, tmp_path):
    (tmp_path / "src/App/bin").mkdir(parents=True)
    (tmp_path / "src/Lib").mkdir()
    (tmp_path / "App.sln").write_text(SOLUTION)
    (tmp_path / "src/App/App.csproj").write_text('\ufeff<Project Sdk="Microsoft.NET.Sdk.Web"><ItemGroup><ProjectReference Include="..\\Lib\\Lib.csproj"/><ProjectReference Include="..\\Gone\\Gone.csproj"/><PackageReference Include="Json"/></ItemGroup></Project>')
    (tmp_path / "src/Lib/Lib.csproj").write_text('<Project Sdk="Microsoft.NET.Sdk"></Project>')
    (tmp_path / "src/App/bin/Copy.csproj").write_text("<Project/>")
    (tmp_path / "src/Lib/Broken.csproj").write_text("<Project")
    projects = files.source_files(spark, str(tmp_path), "*.csproj")
    targets, items = build.csharp_fragment(projects)
    assert {r.id: r.type for r in targets.collect()} == {
        "csharp:project:src/App/App.csproj": "project", "csharp:project:src/Lib/Lib.csproj": "project", "csharp:project:src/Lib/Broken.csproj": "project",
        "csharp:project:src/Gone/Gone.csproj": "placeholder", "csharp:package:Json": "package",
    }
    assert sorted(r.type for r in items.collect()) == ["package_ref", "project_ref", "project_ref"]
    roles = {r.path.rsplit("/")[-1]: r.role for r in projects.select("path", build.sdk_role(projects["text"]).alias("role")).collect()}
    assert roles == {"App.csproj": "service-web", "Lib.csproj": "library", "Broken.csproj": None}
    rows = {r.name: (r.kind, r.file, r.parent) for r in files.parsed(files.source_files(spark, str(tmp_path), "*.sln"), build.solution, build.SOLUTION).collect()}
    assert rows == {"App": ("project", "src/App/App.csproj", "B2"), "src": ("folder", None, None)}
    near = files.nearest_ancestor(spark.createDataFrame([("src/App/x/y.cs",), ("z.cs",)], "path string"), projects.where("path LIKE '%App.csproj'"))
    assert [tuple(r) for r in near.collect()] == [("src/App/x/y.cs", "src/App/App.csproj")]


def test_make_and_cmake():
    assert list(build.make_deps("d", "C:/o.o: a.c \\\n  b.h c\\ d.h # no\n")) == [("d", "C:/o.o", 0, "a.c"), ("d", "C:/o.o", 1, "b.h"), ("d", "C:/o.o", 2, "c d.h")]
    assert list(build.graphviz("g", '"n0" [ label = "app\\n(x)", shape = egg ];\n"n0" -> "n1" [ style = dotted ] // a')) == [("g", "node", "n0", "app", "egg"), ("g", "edge", "n0", "n1", "private")]
    rows = set(build.autotools("src/Makefile.am", "SRC = a.c\nbin_PROGRAMS = tool\ntool_SOURCES = $(SRC) \\\n b.c\ntool_LDADD = libx.la -lm\nnoinst_LTLIBRARIES = libx.la\n"))
    assert ("src/Makefile.am", "tool", "source", "src/b.c") in rows and ("src/Makefile.am", "tool", "library_ref", "libx.la") in rows and ("src/Makefile.am", "libx.la", "library", None) in rows
    assert build.expand("$(A)/$(B)", {"A": "$(A)"}) == "/"
    assert list(build.com_classes("a.idl", "[uuid(AB-1), x] coclass C {}")) == [("a.idl", "clsid", "ab-1")]
    assert list(build.xml_solution("x.slnx", '<Solution><Folder Name="/in/"><Project Path="a\\b.csproj"/></Folder><Project Path="c.csproj"/></Solution>')) == [("x.slnx", "a/b.csproj", "in"), ("x.slnx", "c.csproj", None)]


def test_includes(spark):
    deps = spark.createDataFrame([("d", "o", k, f) for k, f in enumerate(["a.c", "a.h", "b.h", "c.h"])], build.MAKE_DEPS)
    owners = spark.createDataFrame([("a.c", "A"), ("a.h", "A"), ("b.h", "B"), ("c.h", "B")], "file string, id string")
    assert [tuple(r) for r in build.make_includes(deps, owners).collect()] == [("A", "B", "include", "b.h", 2)]


def test_deployment():
    nodes = list(deploy.compose("c.yml", "services:\n  web: {image: shop, depends_on: [db, gone]}\n  db: {image: 'postgres:15'}\n"))
    assert [(n[1], n[2]) for n in nodes] == [("node", "deploy:image:web"), ("node", "infra:database:db"), ("edge", "deploy:image:web")]
    assert deploy.infra_kind("mcr.microsoft.com/mssql/server:2022") == "database" and deploy.infra_kind("my-redis") is None
    node = next(deploy.dockerfile("api/Dockerfile", "FROM sdk AS build\nFROM base:1 AS final\nFROM final\nEXPOSE 8080 80\n"))
    assert node[3:8] == ("api", "image", "base:1", None, "80,8080")
    assert deploy.final_base([("b", "a"), ("a", "b")]) in ("a", "b")
    rows = list(deploy.kubernetes("k.yml", "kind: Deployment\nmetadata: {name: d}\nspec: {replicas: 3, template: {spec: {containers: [{name: w, image: shop, envFrom: [{secretRef: {name: s}}]}]}}}\n---\nkind: Ingress\nmetadata: {name: i}\n"))
    assert [(r[1], r[2], r[7]) for r in rows] == [("node", "deploy:image:w", "replicas=3"), ("edge", "deploy:image:w", "envFrom"), ("node", "infra:ingress:i", "ingress")]
    assert [r[2] for r in deploy.terraform("m.tf", 'resource "aws_s3_bucket" "logs" {}\nresource "aws_iam_role" "r" {}')] == ["infra:storage:logs"]
    assert [r[2] for r in deploy.bicep("m.bicep", "resource cache 'Microsoft.Cache/redis@2023' = {}")] == ["infra:cache:cache"]
    assert [r[2] for r in deploy.arm("t.json", '{"$schema": "x/deploymentTemplate.json#", "resources": [{"type": "Microsoft.Sql/servers", "name": "s"}]}')] == ["infra:database:s"]
    assert [r[2] for r in deploy.helm("c/Chart.yaml", "name: c\ndependencies: [{name: d, version: '1'}]")] == ["deploy:chart:c", "deploy:chart:c"]


def test_parsed_skips_unreadable_files(spark):
    table = spark.createDataFrame([("a.json", "{"), ("b.yml", "services: {x: {}}")], "path string, text string")
    assert files.parsed(table, deploy.arm, deploy.NODES).count() == 0


def test_rsf_round_trip(spark):
    edges = spark.createDataFrame([("a b", "c"), ("c", "c"), ("c", "e")], "source string, target string")
    targets = spark.createDataFrame([("a b", False, "k"), ("c", False, None), ("e", True, "k")], "id string, external boolean, container_id string")
    lines = rsf.depend_lines(edges, targets)
    assert [r.line for r in lines.collect()] == ['depend "a b" c']
    assert [tuple(r) for r in rsf.parse_lines(lines, "line").collect()] == [("depend", "a b", "c")]
    assert sorted(r.line for r in rsf.contain_lines(targets).collect()) == ["contain c c", 'contain k "a b"']


def test_unreadable_files_are_rows(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "bad.csproj").write_text("<Project><ItemGroup>")
    (tmp_path / "a" / "good.csproj").write_text("<Project/>")
    (tmp_path / "compose.yml").write_text("services: [")
    got = {(r.path, r.reader): r.error for r in tree.unread(spark, str(tmp_path)).collect()}
    assert {k for k in got if k[1] != "kubernetes"} == {("a/bad.csproj", "project_refs"), ("compose.yml", "compose")}
    assert got["a/bad.csproj", "project_refs"].startswith("ParseError")
