"""Build descriptions: solutions, projects, CMake graphs and make rules."""

from __future__ import annotations

import posixpath
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from lodestone.sources.files import parsed

_PROJECT = re.compile(r'Project\("\{([^}]*)\}"\)\s*=\s*"([^"]*)",\s*"([^"]*)",\s*"\{([^}]*)\}"')
_NESTED = re.compile(r"\{([0-9A-Fa-f-]+)\}\s*=\s*\{([0-9A-Fa-f-]+)\}")
# Fixed value: the project type of a solution folder.
FOLDER_TYPE = "2150E333-8FDC-42A3-9474-1A3956D46DE8"


def solution(path: str, text: str) -> Iterator[tuple]:
    """``path, kind, guid, name, file, parent`` of the projects and folders of a text solution."""
    section = re.search(r"GlobalSection\(NestedProjects\)(.*?)EndGlobalSection", text, re.S)
    parent = {a.upper(): b.upper() for a, b in _NESTED.findall(section[1] if section else "")}
    for kind, name, file, guid in _PROJECT.findall(text):
        folder = kind.upper() == FOLDER_TYPE
        place = None if folder else posixpath.normpath(posixpath.join(posixpath.dirname(path), file.replace("\\", "/")))
        yield path, "folder" if folder else "project", guid.upper(), name, place, parent.get(guid.upper())


SOLUTION = "solution string, kind string, guid string, name string, file string, parent string"


def xml_solution(path: str, text: str) -> Iterator[tuple]:
    """``solution, file, folder`` of an XML solution; a project outside any folder has null."""
    root = ET.fromstring(text)
    base = posixpath.dirname(path)

    def place(node: ET.Element) -> str:
        return posixpath.normpath(posixpath.join(base, node.get("Path", "").replace("\\", "/")))

    for node in root:
        if node.tag == "Project":
            yield path, place(node), None
        elif node.tag == "Folder":
            for project in node.iter("Project"):
                yield path, place(project), node.get("Name", "").strip("/")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def project_refs(path: str, text: str) -> Iterator[tuple]:
    """``path, kind, ref``: project references as paths of the tree, package references by name."""
    directory = posixpath.dirname(path)
    for node in ET.fromstring(text).iter():
        include = node.get("Include")
        if not include:
            continue
        if _local(node.tag) == "ProjectReference":
            expanded = re.sub(r"\$\((MSBuildThisFileDirectory|MSBuildProjectDirectory|ProjectDir)\)[\\/]?", "", include)
            # A solution lies at the root of its tree, from which all paths count.
            from_root = re.sub(r"^\$\(SolutionDir\)[\\/]?", "", expanded)
            start = directory if from_root == expanded else ""
            if "$(" not in from_root:
                yield path, "project_ref", posixpath.normpath(posixpath.join(start, from_root.replace("\\", "/")))
        elif _local(node.tag) == "PackageReference":
            yield path, "package_ref", include


PROJECT_REFS = "path string, kind string, ref string"


def csharp_fragment(projects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Targets and evidence items of C# projects; a reference to no known file makes a placeholder target."""
    refs = parsed(projects, project_refs, PROJECT_REFS)
    name = lambda c: F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.[a-z]+proj$", "")
    id_of = lambda c: F.concat(F.lit("csharp:project:"), c)
    known = projects.select(id_of(F.col("path")).alias("id"), name(F.col("path")).alias("name"), F.lit("project").alias("type"), "path", F.lit(False).alias("external"))
    target = F.when(F.col("kind") == "package_ref", F.concat(F.lit("csharp:package:"), "ref")).otherwise(id_of(F.col("ref")))
    items = refs.select(id_of(F.col("path")).alias("source"), target.alias("target"), F.col("kind").alias("type"), F.col("ref").alias("detail"), F.lit(None).cast("long").alias("count"), F.lit(None).cast("string").alias("visibility")).distinct()
    packages = refs.where("kind = 'package_ref'").select(F.concat(F.lit("csharp:package:"), "ref").alias("id"), F.col("ref").alias("name"), F.lit("package").alias("type"), F.lit(None).cast("string").alias("path"), F.lit(True).alias("external")).distinct()
    dangling = refs.where("kind = 'project_ref'").select(id_of(F.col("ref")).alias("id"), name(F.col("ref")).alias("name"), F.lit("placeholder").alias("type"), F.col("ref").alias("path"), F.lit(False).alias("external")).distinct().join(known.select("id"), "id", "left_anti")
    return known.unionByName(packages).unionByName(dangling), items


# Roles by SDK name.
def sdk_role(text):
    """Role of a project by its SDK and target framework; null where the SDK says nothing."""
    sdk = F.lower(F.regexp_extract(text, r'<Project\s+Sdk="([^"]+)"', 1))
    framework = F.regexp_extract(text, r"<TargetFrameworks?>([^<]+)</", 1)
    return (
        F.when(sdk == "", F.lit(None).cast("string"))
        .when(sdk.endswith(".web"), "service-web")
        .when(sdk.endswith(".worker"), "service-worker")
        .when(sdk.contains("aspire"), "orchestration")
        .when(sdk.contains("maui") | framework.rlike("android|ios|maccatalyst"), "client-app")
        .when(sdk.contains("razor"), "ui-library")
        .when(sdk == "microsoft.net.sdk", "library")
    )


def graphviz(path: str, text: str) -> Iterator[tuple]:
    """``path, kind, a, b, c``: nodes (name, label, shape) and edges (from, to, visibility) of a CMake graph."""
    visibility = {"solid": "public", "dashed": "interface", "dotted": "private"}
    for line in text.splitlines():
        if m := re.match(r'\s*"([^"]+)"\s*->\s*"([^"]+)"\s*(?:\[(.*?)\])?', line):
            style = re.search(r"style\s*=\s*(\w+)", m[3] or "")
            yield path, "edge", m[1], m[2], visibility.get(style[1] if style else "solid", "public")
        elif m := re.match(r'\s*"([^"]+)"\s*\[(.*)\]', line):
            label, shape = re.search(r'label\s*=\s*"([^"]*)"', m[2]), re.search(r"shape\s*=\s*(\w+)", m[2])
            if label:
                yield path, "node", m[1], label[1].replace("\\n", " ").split(" ")[0], shape[1] if shape else None


GRAPHVIZ = "path string, kind string, a string, b string, c string"


def make_deps(path: str, text: str) -> Iterator[tuple]:
    """``path, output, position, dep`` of make rules; a colon before white space ends the output, a drive's does not."""
    for line in logical_lines(text):
        head = re.match(r"(.*?):(?=\s|$)(.*)", line)
        if head:
            for k, dep in enumerate(head[2].replace("\\ ", "\0").split()):
                yield path, head[1].strip(), k, dep.replace("\0", " ")


MAKE_DEPS = "path string, output string, position int, dep string"


def logical_lines(text: str) -> list[str]:
    """Lines with continuations joined; comments and blanks dropped."""
    joined = re.sub(r"[ \t]*\\\r?\n[ \t]*", " ", text)
    cut = (re.sub(r"(?<!\\)#.*", "", line).rstrip() for line in joined.splitlines())
    return [line for line in cut if line.strip()]


def expand(value: str, variables: dict[str, str], depth: int = 0, most: int = 8) -> str:
    """Make variables replaced, to a bounded depth; unknown ones are empty."""
    if depth >= most:
        return re.sub(r"\$[({][^)}]*[)}]", "", value)
    out = re.sub(r"\$[({]([^)}]*)[)}]|@(\w+)@", lambda m: variables.get(m[1] or m[2], ""), value)
    return expand(out, variables, depth + 1, most) if re.search(r"\$[({]|@\w+@", out) else out


def autotools(path: str, text: str) -> Iterator[tuple]:
    """``path, target, kind, member``: programs and libraries of a Makefile.am with their sources and libraries."""
    variables: dict[str, str] = {}
    for line in logical_lines(text):
        if m := re.match(r"([\w.@]+)\s*(\+?[:?]?=)\s*(.*)", line):
            variables[m[1]] = f"{variables.get(m[1], '')} {m[3]}" if m[2] == "+=" else m[3]
    directory = posixpath.dirname(path)
    for name, value in sorted(variables.items()):
        kind = re.fullmatch(r"(?:\w+_)?(PROGRAMS|LIBRARIES|LTLIBRARIES)", name)
        for target in expand(value, variables).split() if kind else ():
            key = re.sub(r"[^\w@]", "_", target)
            yield path, target, "program" if kind[1] == "PROGRAMS" else "library", None
            for source in expand(variables.get(f"{key}_SOURCES", ""), variables).split():
                yield path, target, "source", posixpath.normpath(posixpath.join(directory, source))
            for library in expand(variables.get(f"{key}_LDADD", "") + " " + variables.get(f"{key}_LIBADD", ""), variables).split():
                if not library.startswith("-"):
                    yield path, target, "library_ref", posixpath.basename(library)


AUTOTOOLS = "path string, target string, kind string, member string"


# Extensions of what a target owns, variables that point to directories, and how automake names kinds.
OWNED = (".c", ".cc", ".cpp", ".cxx", ".h", ".hh", ".hpp", ".hxx", ".y", ".l", ".def", ".s")
_HERE = {"srcdir": ".", "builddir": ".", "EXEEXT": "", "OBJEXT": "o"}
_LIBRARY = re.compile(r"(lib[\w+.-]*?)\.(a|la|so)")
_KIND = {"PROGRAMS": "executable", "LIBRARIES": "static_lib", "LTLIBRARIES": "shared_lib"}


def makefile(path: str, text: str) -> Iterator[tuple]:
    """``path, dir, target, kind, member`` of an automake file or a hand-written makefile.

    Kinds are the target's type, ``primary`` (the target that the directory is for), ``source`` (a file it
    names), ``object`` (a file without its extension) and ``ref`` (a library). Names are taken as relative
    to the makefile and to the top; which of them exist is for a join with the files to say.
    """
    here = posixpath.dirname(path)
    top = posixpath.relpath(".", here) if here else "."
    variables = _HERE | dict.fromkeys(("top_srcdir", "topdir", "top_builddir", "BUILD_DIR"), top)
    rules: list[tuple[str, str]] = []
    for line in logical_lines(text):
        if m := re.match(r"([\w.@]+)\s*(\+?[:?]?=)\s*(.*)", line):
            if m[1] not in _HERE:
                variables[m[1]] = f"{variables.get(m[1], '')} {m[3]}" if m[2] == "+=" else m[3]
        elif not line[0].isspace() and (m := re.match(r"([^:=]+):(?!=)(.*)", line)):
            rules.append((m[1], m[2]))
    rules = [(expand(a, variables).split(), expand(b, variables).split()) for a, b in rules]
    compiled = {posixpath.splitext(posixpath.basename(a[0]))[0]: b for a, b in rules if len(a) == 1 and a[0].endswith((".o", ".lo"))}

    def places(name: str) -> list[str]:
        found = {posixpath.normpath(posixpath.join(here, name)), posixpath.normpath(name)}
        return sorted(x for x in found if not x.startswith(("../", "/")))

    def claims(target: str, tokens: list[str]) -> list[tuple]:
        out = []
        for token in tokens:
            stem, extension = posixpath.splitext(token)
            if extension.lower() in OWNED:
                out += [(target, "source", p) for p in places(token)]
            elif extension in (".o", ".lo"):
                sources = [d for d in compiled.get(posixpath.basename(stem), ()) if posixpath.splitext(d)[1].lower() in OWNED[:4] + (".y", ".l")]
                out += claims(target, sources) if sources else [(target, "object", p) for p in places(stem)]
        return out

    def library(token: str) -> str | None:
        m = _LIBRARY.fullmatch(posixpath.basename(token))
        return m[1] if m else "lib" + token[2:] if token.startswith("-l") and len(token) > 2 else None

    kinds: dict[str, str] = {}
    rows: list[tuple] = []
    for name, value in sorted(variables.items()):
        kind = re.fullmatch(r"(?!EXTRA_)(?:\w+_)?(PROGRAMS|LIBRARIES|LTLIBRARIES)", name)
        for token in expand(value, variables).split() if kind else ():
            target, key = library(token) or posixpath.basename(token), re.sub(r"\W", "_", posixpath.basename(token))
            kinds.setdefault(target, _KIND[kind[1]])
            own = lambda suffix: expand(variables.get(f"{key}_{suffix}", ""), variables).split()
            rows += claims(target, own("SOURCES"))
            rows += [(target, "ref", ref) for token in own("LDADD") + own("LIBADD") if (ref := library(token))]
    if kinds:
        primary = min(kinds, key=lambda t: (kinds[t] == "executable", t))
    else:
        named = library(expand(variables.get("LIBRARY_NAME", ""), variables).strip())
        program = expand(variables.get("Program", ""), variables).strip()
        kinds |= {named: "static_lib"} if named else {}
        kinds |= {program: "executable"} if re.fullmatch(r"[\w+-]+", program) else {}
        for outputs, needs in rules:
            for output in outputs:
                target = library(output) if not output.startswith("-") else None
                found = claims(target or output, needs)
                if target:
                    kinds.setdefault(target, "static_lib")
                elif output in kinds or found and re.fullmatch(r"(?!stamp-)[\w+-]+", output) and output.lower() not in PHONY:
                    kinds.setdefault(output, "executable")
                    found += [(output, "ref", ref) for need in needs if (ref := library(need))]
                else:
                    continue
                rows += found
        libraries = sorted(t for t in kinds if kinds[t] != "executable")
        primary = program if program in kinds else named or (libraries[0] if libraries else next(iter(kinds)) if len(kinds) == 1 else None)
        if primary:
            values = [expand(v, variables).split() for v in variables.values()]
            rows += [r for name in sorted(variables) if name.endswith(("SOURCES", "SRC")) for r in claims(primary, expand(variables[name], variables).split())]
            if kinds[primary] == "executable":
                rows += [(primary, "ref", ref) for tokens in values + [needs for _, needs in rules] for token in tokens if (ref := library(token))]
    rows += [(t, kind, None) for t, kind in kinds.items()] + ([(primary, "primary", None)] if primary else [])
    for row in sorted(set(rows), key=lambda r: (r[0], r[1], r[2] or "")):
        yield path, here, *row


# Fixed value: targets that make no file.
PHONY = frozenset("all install uninstall clean distclean mostlyclean maintainer-clean check test tests depend tags dist force .phony".split())
MAKEFILE = "path string, dir string, target string, kind string, member string"


def vcxproj(path: str, text: str) -> Iterator[tuple]:
    """``path, kind, value``: configuration type, references, sources and include directories."""
    directory = posixpath.dirname(path)
    for node in ET.fromstring(text).iter():
        tag, include = _local(node.tag), node.get("Include")
        if tag == "ConfigurationType" and node.text:
            yield path, "type", node.text.strip()
        elif tag == "ProjectReference" and include:
            yield path, "project_ref", posixpath.normpath(posixpath.join(directory, include.replace("\\", "/")))
        elif tag == "ClCompile" and include:
            yield path, "source", posixpath.normpath(posixpath.join(directory, include.replace("\\", "/")))
        elif tag == "AdditionalIncludeDirectories" and node.text:
            for part in node.text.split(";"):
                if part and not part.startswith(("%", "$")):
                    yield path, "include_dir", posixpath.normpath(posixpath.join(directory, part.replace("\\", "/")))


VCXPROJ = "path string, kind string, value string"


def com_classes(path: str, text: str) -> Iterator[tuple]:
    """``path, kind, value``: class ids of IDL coclass blocks and program ids of registry scripts, lower-cased and in order."""
    found = set()
    if path.lower().endswith(".idl"):
        found = {("clsid", m.lower()) for m in re.findall(r"uuid\(([0-9A-Fa-f-]+)\)[^\]]*\]\s*coclass\b", text)}
    elif path.lower().endswith(".rgs"):
        found = {("progid", m.lower()) for m in re.findall(r"ProgID\s*=\s*s\s*'([^']+)'", text)}
    for kind, value in sorted(found):
        yield path, kind, value


def make_includes(deps: DataFrame, owners: DataFrame) -> DataFrame:
    """Evidence items of includes: the first dependency of an output is its unit; inner ones are dropped."""
    unit = deps.where("position = 0").select("path", "output", F.col("dep").alias("unit"))
    pairs = deps.where("position > 0").join(unit, ["path", "output"])
    named = owners.select(F.col("file").alias("_f"), F.col("id").alias("_id"))
    joined = pairs.join(named, F.col("unit") == F.col("_f")).withColumnRenamed("_id", "source").drop("_f").join(named, F.col("dep") == F.col("_f")).withColumnRenamed("_id", "target")
    return joined.where("source <> target").groupBy("source", "target").agg(F.lit("include").alias("type"), F.min_by("dep", F.struct("path", "output", "position")).alias("detail"), F.count("*").alias("count"))
