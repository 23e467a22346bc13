"""Display names, tags and rule patterns of elements."""

from __future__ import annotations

import fnmatch
import os.path

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestone.functions.identifiers import convention


def qualifier(id_: Column) -> Column:
    """What tells elements of one name apart: the directory above the last part, else the kind."""
    key = F.element_at(F.split(id_, ":"), -1)
    above = F.element_at(F.split(key, "/"), -2)
    return F.when(F.size(F.split(key, "/")) > 1, above).otherwise(F.get(F.split(id_, ":"), F.lit(1)))


def unique_names(siblings: DataFrame, overrides: DataFrame) -> DataFrame:
    """``id, name``: overrides first; names that several siblings share get a qualifier, and the id if that is not enough."""
    named = siblings.join(overrides.select("id", F.col("name").alias("_own")), "id", "left").withColumn("name", F.coalesce("_own", "name"))
    shared = F.count("*").over(Window.partitionBy("name"))
    once = named.withColumn("_n", F.when((shared > 1) & F.col("_own").isNull(), F.concat("name", F.lit(" ("), F.coalesce(qualifier(F.col("id")), "id"), F.lit(")"))).otherwise(F.col("name")))
    again = F.count("*").over(Window.partitionBy("_n"))
    return once.select("id", F.when((again > 1) & F.col("_own").isNull(), F.concat("name", F.lit(" ("), "id", F.lit(")"))).otherwise(F.col("_n")).alias("name"))


def outliers(siblings: DataFrame, group: str) -> DataFrame:
    """Names whose convention is not their group's most frequent, ties to the smaller; groups of one have none."""
    styled = siblings.withColumn("style", convention(F.col("name"))).where("style <> 'other'")
    counted = styled.groupBy(group, "style").agg(F.count("*").alias("n"))
    main = counted.groupBy(group).agg(F.min_by("style", F.struct(-F.col("n"), "style")).alias("main"))
    return styled.join(main, group).where("style <> main").select(group, "id", "name", "style", "main")


def edge_tags(kind: Column, types: Column, declared: Column, confidence: Column, own: Column) -> Column:
    """Sorted tags of an edge: kind, evidence types, declaration, confidence, and those of curation."""
    first = F.filter(F.array(F.concat(F.lit("kind:"), kind), F.when(declared, F.lit("declared")), F.concat(F.lit("confidence:"), confidence)), lambda x: x.isNotNull())
    return F.array_sort(F.array_distinct(F.concat(first, types, F.coalesce(own, F.array().cast("array<string>")))))


def boundary_member(external: Column, tags: Column) -> Column:
    return F.coalesce(external, F.lit(False)) | F.coalesce(F.arrays_overlap(tags, F.array(F.lit("external"), F.lit("person"))), F.lit(False))


def size_score(members: Column, lines: Column, namespaces: Column, degree: Column) -> Column:
    return 3 * members + lines / 200 + namespaces + 1.5 * degree


def normal_label(label: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(label), r"[\s_./-]+", " "))


def tightest_glob(chosen: list[str], targets: list[dict]) -> str | None:
    """A common beginning with ``*`` over ids, then paths, then names, that claims exactly the chosen targets."""
    want = set(chosen)
    picked = [t for t in targets if t["id"] in want]
    for key in ("id", "path", "name"):
        values = [t.get(key) for t in picked]
        if not values or any(not v for v in values):
            continue
        shared = os.path.commonprefix(values)
        if not shared:
            continue
        pattern = shared + "*"
        hit = {t["id"] for t in targets if any(t.get(k) and fnmatch.fnmatchcase(t[k], pattern) for k in ("id", "path", "name"))}
        if hit == want:
            return pattern
    return None
