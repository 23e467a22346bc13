"""Fragments to one model: every field merged by its own law."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from lodestone.operators import merge
from lodestone.sources import fragments as fr

SCALARS = ("name", "type", "language", "path")
LISTS = ("tags", "namespaces", "depends_on", "responsibilities", "com_provides", "package_refs")


@dataclass
class Facts:
    targets: DataFrame
    edges: DataFrame
    coverage: DataFrame
    conflicts: DataFrame
    components: DataFrame
    deploy_nodes: DataFrame
    deploy_edges: DataFrame


def merged_targets(rows: DataFrame) -> DataFrame:
    """One row per id: scalars by an ordered fold over the fragments, lists united, external by priority."""
    out = rows.select("id").distinct()
    for field in SCALARS:
        out = out.join(merge.scalar_winner(rows.select("id", "fragment", "priority", field), field=field), "id", "left")
    lists = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>")))))).alias(c) for c in LISTS]
    flags = merge.external_flag(rows.where("external IS NOT NULL").select("id", "priority", "external"))
    return out.join(rows.groupBy("id").agg(*lists), "id").join(flags, "id", "left").withColumn("external", F.coalesce("external", F.lit(False)))


def conflicts(rows: DataFrame) -> DataFrame:
    """What lost against what, for every scalar field."""
    every = None
    for field in SCALARS:
        values = rows.select("id", "fragment", "priority", F.col(field).alias("value"))
        part = merge.conflict_ledger(values).withColumn("field", F.lit(field))
        every = part if every is None else every.unionByName(part)
    return every


def components(rows: DataFrame) -> DataFrame:
    """Children of targets and their code, united by id: ``target, id, level, name, tags, parent``."""
    upper = rows.select(F.col("id").alias("target"), "fragment", F.explode("components").alias("c"))
    own = upper.select("target", "fragment", "c.id", "c.level", "c.name", "c.tags", F.lit(None).cast("string").alias("parent"))
    code = upper.select("target", "fragment", F.col("c.id").alias("parent"), F.explode("c.code").alias("k")).select("target", "fragment", "k.id", "k.level", "k.name", "k.tags", "parent")
    every = own.unionByName(code).where("id IS NOT NULL")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("fragment"))).alias(c)
    return every.groupBy("target", "id").agg(first("level"), first("name"), first("parent"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("tags", F.array().cast("array<string>")))))).alias("tags"))


def deployment(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deployment nodes by id, with lists united and gaps filled in fragment order; distinct edges."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("fragment"))).alias(c)
    lists = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>")))))).alias(c) for c in ("ports", "tags")]
    return nodes.groupBy("id").agg(*(first(c) for c in ("name", "kind", "subkind", "technology", "env", "replicas", "external")), *lists), edges.groupBy("source", "target", "kind").agg(first("env"))


def normalize(fragments: DataFrame) -> Facts:
    """The model of a table of fragments; the order of its rows does not matter, that of file names does."""
    rows, items = fr.targets(fragments), fr.items(fragments)
    nodes, links = deployment(*fr.deployment(fragments))
    kinds = items.groupBy("source", "target").agg(F.min_by("kind", F.when(F.col("kind").isNotNull(), F.col("fragment"))).alias("kind"))
    edges = merge.edges_of(merge.merge_evidence(items.where("type IS NOT NULL"))).join(kinds, ["source", "target"])
    return Facts(merged_targets(rows), edges, merge.best_coverage(fr.coverage(fragments)), conflicts(rows), components(rows), nodes, links)


def element_ids(facts: Facts) -> DataFrame:
    """Ids of all targets, components and code elements."""
    return facts.targets.select("id").union(facts.components.select("id")).distinct()
