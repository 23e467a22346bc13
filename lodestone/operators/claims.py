"""Exclusive ownership: overlapping claims on files, one owner a file, leftovers to the nearest primary target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def directory(path: Column) -> Column:
    """The directory of a path, empty at the top."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def ancestors(folder: Column) -> Column:
    """A directory and all above it, the top (empty) included."""
    cut = F.split(folder, "/")
    return F.array_union(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(cut)), lambda k: F.array_join(F.slice(cut, 1, k), "/")))


def canonical(declared: DataFrame) -> DataFrame:
    """``target, dir, type, primary``: one row a name from ``target, dir, type, primary`` of several makefiles.

    The deepest directory speaks for a name (ties: the smaller one); a name that is primary anywhere is primary.
    """
    best = F.struct(-F.length("dir"), "dir", "type")
    return declared.groupBy("target").agg(F.min_by("dir", best).alias("dir"), F.min_by("type", best).alias("type"), F.bool_or("primary").alias("primary"))


def explicit(claims: DataFrame, targets: DataFrame) -> DataFrame:
    """``file, target, n_claims``: of all targets that name a file its one owner.

    First comes a target whose own directory holds the file, then the deepest directory, then the
    primary target, then the smaller name. The top directory holds only the files right in it.
    """
    joined = claims.select("file", "target").distinct().join(targets.select("target", "dir", "primary"), "target")
    folder, own = directory(F.col("file")), F.col("dir")
    inside = (folder == own) | ((own != "") & F.startswith(folder, F.concat(own, F.lit("/"))))
    rank = F.struct(~inside, -F.length("dir"), ~F.col("primary"), "target")
    return joined.groupBy("file").agg(F.min_by("target", rank).alias("target"), F.count("*").alias("n_claims"))


def leftover(files: DataFrame, taken: DataFrame, places: DataFrame, targets: DataFrame) -> DataFrame:
    """``file, target`` of the files that nobody names: the primary target of the nearest makefile at or above them.

    ``places`` are the directories (``dir``) with a makefile. A nearest makefile without a primary target
    gives none, its files are not handed further up. Of several primary targets of a directory the first counts.
    """
    free = files.select("file").distinct().join(taken.select("file"), "file", "left_anti")
    # The folders of files are far fewer than the files.
    folders = free.select(directory(F.col("file")).alias("folder")).distinct()
    near = folders.select("folder", F.explode(ancestors(F.col("folder"))).alias("dir")).join(places.select("dir").distinct(), "dir")
    near = near.groupBy("folder").agg(F.max_by("dir", F.length("dir")).alias("dir"))
    primary = targets.where("primary").groupBy("dir").agg(F.min("target").alias("target"))
    owned = near.join(primary, "dir").select("folder", "target")
    return free.withColumn("folder", directory(F.col("file"))).join(owned, "folder").select("file", "target")


def exclusive(files: DataFrame, claims: DataFrame, targets: DataFrame, places: DataFrame) -> DataFrame:
    """``file, target, how, n_claims``: each file's one owner, ``claim`` or ``nearest``; files without any have no row.

    Claims on files that are not there are ignored.
    """
    taken = explicit(claims.join(files.select("file").distinct(), "file", "left_semi"), targets)
    rest = leftover(files, taken, places, targets)
    return taken.select("file", "target", F.lit("claim").alias("how"), "n_claims").unionByName(rest.select("file", "target", F.lit("nearest").alias("how"), F.lit(0).cast("long").alias("n_claims")))


def link_edges(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target`` of references (``target, ref``) that name a library of the model other than the target itself."""
    libraries = targets.where(F.col("type").isin("static_lib", "shared_lib")).select(F.col("target").alias("ref"))
    known = refs.join(targets.select("target"), "target", "left_semi").join(libraries, "ref", "left_semi")
    return known.where("target <> ref").select(F.col("target").alias("source"), F.col("ref").alias("target")).distinct()


def alive(targets: DataFrame, owned: DataFrame, edges: DataFrame) -> DataFrame:
    """Targets that own a file or lie on an edge: what lost every file to others is build ceremony."""
    used = owned.select("target").unionByName(edges.select(F.col("source").alias("target"))).unionByName(edges.select("target")).distinct()
    return targets.join(used, "target", "left_semi")
