"""Exclusive ownership of files by makefile targets."""

from lodestone.sources import tree


def model(spark, root, files):
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text or "/* nothing */")
    from lodestone.sources.files import source_files

    sources = source_files(spark, str(root), "*.{c,h,y,def}").selectExpr("path AS file")
    targets, owned, edges = tree.make_model(source_files(spark, str(root), "Makefile.{am,in}"), sources)
    types = {r["target"]: r["type"] for r in targets.collect()}
    return types, {r["file"]: r["target"] for r in owned.collect()}, sorted(map(tuple, edges.collect()))


def test_automake(spark, tmp_path):
    text = "lib_LTLIBRARIES = libtree.la\nlibtree_la_SOURCES = parser.c \\\n  tree.c\nbin_PROGRAMS = lint\nlint_SOURCES = tool.c\nlint_LDADD = libtree.la -lm\n"
    types, owned, edges = model(spark, tmp_path, {"Makefile.am": text, "parser.c": "", "tree.c": "", "tool.c": "", "extra.h": "", "sub/deep.c": ""})
    assert types == {"libtree": "shared_lib", "lint": "executable"} and edges == [("lint", "libtree")]
    # What nobody names goes to the library that the directory is for.
    assert owned == {"parser.c": "libtree", "tree.c": "libtree", "tool.c": "lint", "extra.h": "libtree", "sub/deep.c": "libtree"}


def test_auxiliary_rules_do_not_steal(spark, tmp_path):
    inner = "DEFSRC = $(srcdir)/alias.def\nlibbuiltins.a: $(OFILES)\n\t$(AR) cr $@\nhelpdoc: $(DEFSRC)\n\t$(BUILD_DOC)\n"
    types, owned, _ = model(spark, tmp_path, {"Makefile.in": "Program = app$(EXEEXT)\nCSOURCES = app.c\n", "app.c": "", "builtins/Makefile.in": inner, "builtins/alias.def": ""})
    assert owned == {"app.c": "app", "builtins/alias.def": "libbuiltins"} and types == {"app": "executable", "libbuiltins": "static_lib"}


def test_deep_makefiles_own_their_trees(spark, tmp_path):
    outer = "Program = shell\nGLOB = lib/glob/libglob.a\nCSOURCES = shell.c lib/glob/glob.c parse.y\n$(GLOB): force\n\tcd lib/glob && make\nshell: shell.o jobs.o $(GLOB)\n"
    glob = "LIBRARY_NAME = libglob.a\nOBJECTS = glob.o\nCSOURCES = glob.c\nlibglob.a: glob.o xmbs.o\n"
    files = {"Makefile.in": outer, "Makefile.am.txt": "", "shell.c": "", "jobs.c": "", "jobs.h": "", "parse.y": "", "lib/glob/Makefile.in": glob, "lib/glob/glob.c": "", "lib/glob/xmbs.c": "", "lib/glob/a/b.h": "", "lib/x.c": "", "none/Makefile.in": "all:\n", "none/lost.c": ""}
    types, owned, edges = model(spark, tmp_path, files)
    assert owned == {"shell.c": "shell", "jobs.c": "shell", "jobs.h": "shell", "parse.y": "shell", "lib/x.c": "shell", "lib/glob/glob.c": "libglob", "lib/glob/xmbs.c": "libglob", "lib/glob/a/b.h": "libglob"}
    assert types == {"shell": "executable", "libglob": "static_lib"} and edges == [("shell", "libglob")]


def test_only_configured_trees_are_read(spark, tmp_path):
    for name in ("cmake", "plain", "right"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "Makefile.in").write_text("Program = x\nCSOURCES = x.c\n")
        (tmp_path / name / "x.c").write_text("int x;")
    (tmp_path / "cmake" / "CMakeLists.txt").write_text("project(x)")
    for name in ("cmake", "right"):
        (tmp_path / name / "configure.ac").write_text("AC_INIT")
    got = {name: [r["name"] for r in tree.autotools(spark, str(tmp_path / name)).targets.collect()] for name in ("cmake", "plain", "right")}
    assert got == {"cmake": [], "plain": [], "right": ["x"]}
