"""One model from a source tree: targets, evidence items, tags and coverage of every reader that applies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodestone.operators import claims, merge
from lodestone.session import materialise
from lodestone.sources import build, code, deploy, files, sidecars

ITEM = "source string, target string, type string, detail string, count long, visibility string, fragment string"
TARGET = "id string, name string, type string, path string, external boolean, tags array<string>, com_provides array<string>, fragment string, priority int"
# Kinds of targets by configuration type.
CONFIGURATIONS = {"Application": "executable", "StaticLibrary": "static_lib", "DynamicLibrary": "shared_lib", "Utility": "unknown"}
_NOTHING = "array<string>"


@dataclass
class Extract:
    """Rows of all readers; ``coverage`` is ``id, layer, value, fragment``."""

    targets: DataFrame
    items: DataFrame
    coverage: DataFrame
    deploy_nodes: DataFrame

    def edges(self) -> DataFrame:
        return merge.edges_of(merge.merge_evidence(self.items))

    def united(self) -> DataFrame:
        """One row per target: scalars by priority of their readers, tags and COM identities united."""
        out = self.targets.select("id").distinct()
        for field in ("name", "type", "path"):
            out = out.join(merge.scalar_winner(self.targets.select("id", "fragment", "priority", field), field=field), "id", "left")
        lists = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("tags", "com_provides")]
        flags = merge.external_flag(self.targets.select("id", "priority", "external"))
        return out.join(self.targets.groupBy("id").agg(*lists), "id").join(flags, "id")


def _base(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]+$", "")


def _none(kind: str = _NOTHING) -> Column:
    return F.array().cast(kind)


def _targets(rows: DataFrame, fragment: str, priority: int) -> DataFrame:
    for column in ("tags", "com_provides"):
        if column not in rows.columns:
            rows = rows.withColumn(column, _none())
    return rows.select("id", "name", "type", "path", "external", "tags", "com_provides", F.lit(fragment).alias("fragment"), F.lit(priority).alias("priority"))


def _items(rows: DataFrame, fragment: str) -> DataFrame:
    return rows.select("source", "target", "type", "detail", F.lit(None).cast("long").alias("count"), F.lit(None).cast("string").alias("visibility"), F.lit(fragment).alias("fragment"))


def folder_tags(solutions: DataFrame, xml: DataFrame) -> DataFrame:
    """``path, tag``: the outermost solution folder of each project, from text and XML solutions."""
    rows = files.parsed(solutions, build.solution, build.SOLUTION)
    folders = rows.where("kind = 'folder'").select("solution", F.col("guid").alias("parent"), F.col("name").alias("_name"), F.col("parent").alias("_up"))
    open_ = rows.where("kind = 'project' AND parent IS NOT NULL").select("solution", "file", "parent")
    found = None
    # Folders lie in folders; a solution's nesting is as deep as its author made it by hand.
    for _ in range(32):
        step = open_.join(folders, ["solution", "parent"])
        done = step.where("_up IS NULL").select(F.col("file").alias("path"), F.concat(F.lit("slnfolder:"), "_name").alias("tag"))
        found = done if found is None else found.unionByName(done)
        open_ = step.where("_up IS NOT NULL").select("solution", "file", F.col("_up").alias("parent"))
        if open_.isEmpty():
            break
    else:
        raise ValueError("solution folders run in a circle")
    listed = files.parsed(xml, build.xml_solution, "solution string, file string, folder string").where("folder IS NOT NULL")
    return found.unionByName(listed.select(F.col("file").alias("path"), F.concat(F.lit("slnfolder:"), F.split_part("folder", F.lit("/"), F.lit(1))).alias("tag"))).distinct()


def managed(spark: SparkSession, root: str) -> Extract:
    """C# projects: references and packages, solution folders, SDK roles, plugin types, and both coverages."""
    projects = files.source_files(spark, root, "*.csproj")
    targets, items = build.csharp_fragment(projects)
    id_of = F.concat(F.lit("csharp:project:"), "path").alias("id")
    tags = folder_tags(files.source_files(spark, root, "*.sln"), files.source_files(spark, root, "*.slnx")).select(id_of, "tag")
    roles = projects.select(id_of, F.concat(F.lit("sdk-role:"), build.sdk_role(F.col("text"))).alias("tag"))
    plugins = projects.select(id_of, F.concat(F.lit("plugin-type:"), code.plugin_type(_base(F.col("path")))).alias("tag"))
    manifests = code.primary_category(files.source_files(spark, root, "Manifest.cs"))
    owned = files.nearest_ancestor(manifests.select("path"), projects.select("path")).join(manifests, "path")
    categories = owned.select(F.concat(F.lit("csharp:project:"), "project").alias("id"), F.concat(F.lit("module-category:"), "category").alias("tag"))
    every = tags.unionByName(roles).unionByName(plugins).unionByName(categories).where("tag IS NOT NULL")
    tagged = targets.join(every.groupBy("id").agg(F.array_sort(F.collect_set("tag")).alias("tags")), "id", "left").withColumn("tags", F.coalesce("tags", _none()))
    restored = files.parsed(spark_files(spark, root, "project.assets.json"), sidecars.restored_packages, sidecars.PACKAGES)
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    packages = projects.select("path", folder.alias("project")).join(restored.select("project", "package"), "project")
    names = packages.select(F.concat(F.lit("csharp:package:"), "package").alias("id"), F.col("package").alias("name"), F.lit("package").alias("type"), F.lit(None).cast("string").alias("path"), F.lit(True).alias("external")).distinct()
    more = packages.select(F.concat(F.lit("csharp:project:"), "path").alias("source"), F.concat(F.lit("csharp:package:"), "package").alias("target"), F.lit("package_ref").alias("type"), F.col("package").alias("detail"))
    l1 = projects.select("path", folder.alias("project")).join(packages.select("project").distinct().withColumn("_has", F.lit(True)), "project", "left")
    coverage = projects.select(id_of, F.lit("L0").alias("layer"), F.lit("true").alias("value")).unionByName(l1.select(id_of, F.lit("L1").alias("layer"), F.when(F.col("_has"), "true").otherwise("false").alias("value")))
    rows = _targets(tagged, "build_graph", 100).unionByName(_targets(names, "build_graph", 100))
    return Extract(rows, _items(items, "build_graph").unionByName(_items(more, "build_graph")).distinct(), coverage.withColumn("fragment", F.lit("build_graph")), _no_nodes(spark))


def spark_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Files by name, those in product directories too: restore results lie there."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    place = root.rstrip("/").split("://")[-1].removeprefix("file:")
    path = F.regexp_replace(F.substring_index(F.regexp_replace("path", r"^[a-z]+:/*", "/"), place.rstrip("/") + "/", -1), "^/+", "")
    return found.select(path.alias("path"), F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "").alias("text"))


def native(spark: SparkSession, root: str) -> Extract:
    """C++ projects: kind, references and the COM identities that lie in their directories."""
    projects = files.source_files(spark, root, "*.vcxproj")
    rows = files.parsed(projects, build.vcxproj, build.VCXPROJ)
    id_of = lambda c: F.concat(F.lit("cxx:project:"), c)
    table = F.create_map(*(F.lit(x) for pair in CONFIGURATIONS.items() for x in pair))
    kinds = rows.where("kind = 'type'").groupBy("path").agg(F.min("value").alias("_type"))
    places = [files.source_files(spark, root, p) for p in ("*.idl", "*.rgs")]
    classes = files.parsed(places[0].unionByName(places[1]), build.com_classes, "path string, kind string, value string")
    owned = files.nearest_ancestor(classes.select("path").distinct(), projects.select("path")).join(classes, "path")
    provides = owned.groupBy(F.col("project").alias("path")).agg(F.array_sort(F.collect_set("value")).alias("com_provides"))
    known = projects.select("path").join(kinds, "path", "left").join(provides, "path", "left").select(
        id_of(F.col("path")).alias("id"), _base(F.col("path")).alias("name"), F.coalesce(table[F.col("_type")], F.lit("unknown")).alias("type"), "path", F.lit(False).alias("external"), F.coalesce("com_provides", _none()).alias("com_provides")
    )
    refs = rows.where("kind = 'project_ref'").select(id_of(F.col("path")).alias("source"), id_of(F.col("value")).alias("target"), F.lit("project_ref").alias("type"), F.col("value").alias("detail"))
    missing = refs.select(F.col("target").alias("id"), _base(F.col("detail")).alias("name"), F.lit("placeholder").alias("type"), F.col("detail").alias("path"), F.lit(False).alias("external")).distinct().join(known.select("id"), "id", "left_anti")
    coverage = projects.select(id_of(F.col("path")).alias("id"), F.lit("L0").alias("layer"), F.lit("true").alias("value"), F.lit("msbuild_cpp").alias("fragment"))
    return Extract(_targets(known, "msbuild_cpp", 100).unionByName(_targets(missing, "msbuild_cpp", 100)), _items(refs, "msbuild_cpp"), coverage, _no_nodes(spark))


def make_model(makefiles: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Targets (``target, dir, type, primary``), owners (``file, target, how, n_claims``) and link edges of makefiles (``path, text``).

    ``sources`` are the files (``file``) that may be owned. Of a directory's makefiles the automake file counts.
    """
    folder = claims.directory(F.col("path"))
    one = makefiles.groupBy(folder.alias("dir")).agg(F.min_by(F.struct("path", "text"), "path").alias("x")).select("x.*")
    rows = materialise(files.parsed(one, build.makefile, build.MAKEFILE), "makefiles")
    mark = rows.where("kind = 'primary'").select("dir", "target", F.lit(True).alias("_primary"))
    declared = rows.where(F.col("kind").isin("executable", "static_lib", "shared_lib")).select("dir", "target", F.col("kind").alias("type"))
    declared = declared.join(mark, ["dir", "target"], "left").select("target", "dir", "type", F.coalesce("_primary", F.lit(False)).alias("primary"))
    targets = materialise(claims.canonical(declared), "targets")
    named = rows.where("kind = 'source'").select(F.col("member").alias("file"), "target")
    stems = sources.select("file", F.regexp_replace("file", r"\.[^./]*$", "").alias("member")).where(F.lower("file").rlike(r"\.(c|cc|cpp|cxx|y|l)$"))
    objects = rows.where("kind = 'object'").select("member", "target").join(stems, "member").select("file", "target")
    owned = materialise(claims.exclusive(sources, named.unionByName(objects), targets, one.select(claims.directory(F.col("path")).alias("dir"))), "owned")
    edges = materialise(claims.link_edges(rows.where("kind = 'ref'").select("target", F.col("member").alias("ref")), targets), "links")
    return claims.alive(targets, owned, edges), owned, edges


def autotools(spark: SparkSession, root: str) -> Extract:
    """Programs and libraries of makefiles: each source has one owner, link references are edges.

    Reads only trees with a configure script and a makefile at the top, and no CMake description there.
    """
    marks = {r["path"] for name in ("{configure,configure.ac,configure.in}", "Makefile.{am,in}", "CMakeLists.txt") for r in files.source_files(spark, root, name).where(~F.col("path").contains("/")).select("path").collect()}
    makefiles = files.source_files(spark, root, "Makefile.{am,in}")
    if "CMakeLists.txt" in marks or not any(m.startswith("configure") for m in marks) or not any(m.startswith("Makefile") for m in marks):
        makefiles = makefiles.where(F.lit(False))
    sources = files.source_files(spark, root, "*.{" + ",".join(e[1:] for e in build.OWNED) + "}").select(F.col("path").alias("file"))
    targets, _, edges = make_model(makefiles, sources)
    id_of = lambda c: F.concat(F.lit("cxx:make:"), c)
    known = targets.select(id_of(F.col("target")).alias("id"), F.col("target").alias("name"), "type", F.col("dir").alias("path"), F.lit(False).alias("external"))
    items = edges.select(id_of(F.col("source")).alias("source"), id_of(F.col("target")).alias("target"), F.lit("link").alias("type"), F.concat(F.lit("makefile: "), "source", F.lit(" links "), "target").alias("detail"))
    coverage = known.select("id", F.lit("L0").alias("layer"), F.lit("true").alias("value"), F.lit("autotools").alias("fragment"))
    return Extract(_targets(known, "autotools", 100), _items(items, "autotools"), coverage, _no_nodes(spark))


def _sources(spark: SparkSession, root: str) -> DataFrame:
    return files.source_files(spark, root, "*.{cs,cpp,cc,cxx,c,h,hpp,py,java,go}")


def _owners(spark: SparkSession, root: str) -> DataFrame:
    return files.source_files(spark, root, "*.{csproj,vcxproj}").select("path")


def _project_id(path: Column) -> Column:
    return F.when(path.endswith(".csproj"), F.concat(F.lit("csharp:project:"), path)).otherwise(F.concat(F.lit("cxx:project:"), path))


def seams(spark: SparkSession, root: str) -> Extract:
    """Language boundaries: an edge from the owning project to each boundary, the first place as detail; owners are tagged."""
    sources = _sources(spark, root)
    found = files.parsed(sources, code.interop, code.INTEROP)
    owned = files.nearest_ancestor(found.select("path").distinct(), _owners(spark, root)).join(found, "path")
    boundary = F.concat(F.lit("boundary:"), "kind", F.lit(":"), F.lower("name"))
    rows = owned.select(_project_id(F.col("project")).alias("source"), boundary.alias("target"), "name", "kind", "path", "position")
    first = rows.groupBy("source", "target").agg(F.min_by("path", F.struct("path", "position")).alias("detail"))
    outside = rows.groupBy(F.col("target").alias("id")).agg(F.min("name").alias("name"), F.min("kind").alias("type")).withColumns({"path": F.lit(None).cast("string"), "external": F.lit(True)})
    owners = rows.groupBy(F.col("source").alias("id")).agg(F.array_sort(F.collect_set(F.concat(F.lit("seam:"), "kind"))).alias("tags"))
    tagged = owners.select("id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("path"), F.lit(False).alias("external"), "tags")
    coverage = owners.select("id", F.lit("interop").alias("layer"), F.lit("true").alias("value"), F.lit("interop").alias("fragment"))
    return Extract(_targets(outside, "interop", 10).unionByName(_targets(tagged, "interop", 10)), _items(first.withColumn("type", F.lit("interop")), "interop"), coverage, _no_nodes(spark))


def contracts(spark: SparkSession, root: str) -> Extract:
    """Contract files as targets, and an edge from each project whose sources name one; without a project, from the directory."""
    globs = "*.{" + ",".join(e[1:] for e in code.CONTRACTS) + "}"
    found = files.source_files(spark, root, globs)
    sources = _sources(spark, root)
    refs = code.contract_references(sources, found)
    near = files.nearest_ancestor(refs.select("path").distinct(), _owners(spark, root))
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(".")
    ends = refs.join(near, "path", "left").select(F.coalesce(_project_id(F.col("project")), F.concat(F.lit("dir:"), folder)).alias("source"), F.concat(F.lit("contract:"), "contract").alias("target"), _base(F.col("contract")).alias("_stem")).distinct()
    items = ends.groupBy("source", "target").agg(F.lit("package_ref").alias("type"), F.concat(F.lit("references "), F.min("_stem")).alias("detail"))
    rows = found.select(F.concat(F.lit("contract:"), "path").alias("id"), _base(F.col("path")).alias("name"), F.lit("contract").alias("type"), "path", F.lit(False).alias("external"), F.array(F.lit("contract")).alias("tags"))
    return Extract(_targets(rows, "contracts", 30), _items(items, "contracts"), _no_coverage(spark), _no_nodes(spark))


def _no_coverage(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "id string, layer string, value string, fragment string")


def _no_nodes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], deploy.NODES)


_DEPLOYED = (
    ("{docker-compose,compose}*.{yml,yaml}", deploy.compose), ("Dockerfile*", deploy.dockerfile), ("*.{yml,yaml}", deploy.kubernetes), ("*.tf", deploy.terraform),
    ("*.bicep", deploy.bicep), ("*.json", deploy.arm),
)
_READ = (
    ("*.sln", build.solution), ("*.slnx", build.xml_solution), ("*.csproj", build.project_refs), ("*.vcxproj", build.vcxproj), ("*.{idl,rgs}", build.com_classes), ("Makefile.{am,in}", build.makefile),
    ("*.{cs,cpp,cc,cxx,c,h,hpp,py,java,go}", code.interop),
)


def unread(spark: SparkSession, root: str) -> DataFrame:
    """``path, reader, error`` of every file of a tree that a reader of ``extract`` could not read; nothing vanishes without a word."""
    out = None
    for pattern, reader in (*_READ, *_DEPLOYED):
        part = files.unread(files.source_files(spark, root, pattern), reader)
        out = part if out is None else out.unionByName(part)
    return out


def deployment(spark: SparkSession, root: str) -> Extract:
    """Nodes and calls of compose files, container, cluster and infrastructure descriptions; calls become evidence of the running system."""
    rows = None
    for pattern, reader in _DEPLOYED:
        part = files.parsed(files.source_files(spark, root, pattern), reader, deploy.NODES)
        rows = part if rows is None else rows.unionByName(part)
    calls = rows.where("record = 'edge'").select(F.col("id").alias("source"), "target", F.lit("runtime").alias("type"), "detail")
    return Extract(spark.createDataFrame([], TARGET), _items(calls, "runtime"), _no_coverage(spark), rows.where("record = 'node'"))


def extract(spark: SparkSession, root: str) -> Extract:
    """All readers over one tree, their rows side by side; ``united`` and ``edges`` make the model of them."""
    parts = [reader(spark, root) for reader in (managed, native, autotools, seams, contracts, deployment)]
    whole = parts[0]
    for part in parts[1:]:
        whole = Extract(*(getattr(whole, f).unionByName(getattr(part, f)) for f in ("targets", "items", "coverage", "deploy_nodes")))
    return whole
