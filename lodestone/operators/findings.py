"""Findings of several detectors as one ranked report, and what could be tried about them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lodestone.operators.lift import cross_edges

SCHEMA = "kind string, element string, severity double"


def report(findings: dict[str, DataFrame], top: int | None = None) -> DataFrame:
    """``kind, element, severity, total`` of all findings, the most severe first; ``top`` of them at most.

    Each table has ``element`` and ``severity``. The number of all findings stands in every row.
    """
    every = None
    for kind, table in sorted(findings.items()):
        part = table.select(F.lit(kind).alias("kind"), F.col("element").cast("string").alias("element"), F.col("severity").cast("double").alias("severity"))
        every = part if every is None else every.unionByName(part)
    total = F.broadcast(every.agg(F.count("*").alias("total")))
    ranked = every.join(total).orderBy(F.desc("severity"), "kind", "element")
    return ranked.limit(top) if top else ranked


def transport_split(edges: DataFrame, targets: DataFrame, most: float = 0.34, least: int = 4) -> DataFrame:
    """``majority, minority, total`` of the seam types between containers, where the minority is small but there."""
    seams = cross_edges(edges, targets).select(F.explode(F.array_distinct(F.transform("evidence", lambda e: e["type"]))).alias("type")).where(F.col("type").isin("interop", "runtime", "package_ref"))
    counted = seams.groupBy("type").agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    ranked = counted.withColumns({"_r": F.row_number().over(Window.orderBy(F.desc("n"), "type")), "total": F.sum("n").over(every)})
    top = ranked.where("_r = 1").select(F.col("type").alias("majority"), (F.col("total") - F.col("n")).alias("minority"), "total")
    return top.where((F.col("minority") > 0) & (F.col("minority") / F.col("total") <= most) & (F.col("total") >= least))


def dominant_seam(edges: DataFrame, targets: DataFrame, least: int = 3) -> DataFrame:
    """The container with most interop seams, where there are ``least`` in all."""
    seams = cross_edges(edges.where(F.exists("evidence", lambda e: e["type"] == "interop")), targets)
    counted = seams.groupBy(F.col("source_container").alias("container_id")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    ranked = counted.withColumns({"_r": F.row_number().over(Window.orderBy(F.desc("n"), "container_id")), "total": total})
    return ranked.where((F.col("_r") == 1) & (F.col("total") >= least)).drop("_r")


def pattern_counts(types: DataFrame, markers: list[tuple[str, str]], least: int = 3) -> DataFrame:
    """``pattern, container_id, n``: types whose text holds a pattern's marker; patterns seen ``least`` times in all."""
    hits = F.array_distinct(F.array_compact(F.array(*(F.when(F.col("text").contains(marker), F.lit(name)) for name, marker in markers))))
    found = types.select("container_id", F.explode(hits).alias("pattern"))
    counted = found.groupBy("pattern", "container_id").agg(F.count("*").alias("n"))
    return counted.withColumn("_t", F.sum("n").over(Window.partitionBy("pattern"))).where(F.col("_t") >= least).drop("_t")


def weakest_cycle_edges(edges: DataFrame, components: DataFrame) -> DataFrame:
    """The edge to cut first in each cycle: the lightest inside it, ties by its ends."""
    a = components.select(F.col("node").alias("source"), F.col("component").alias("component"))
    b = components.select(F.col("node").alias("target"), F.col("component").alias("_c"))
    inner = edges.join(a, "source").join(b, "target").where("component = _c")
    return inner.groupBy("component").agg(F.min(F.struct("weight", "source", "target")).alias("e")).select("component", "e.source", "e.target", "e.weight")


def busiest_members(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """The member of each container with most edges from outside, of containers with two members or more."""
    outer = cross_edges(edges, targets).groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n"))
    many = targets.groupBy("container_id").agg(F.count("*").alias("m")).where("m >= 2").select("container_id")
    ranked = targets.join(many, "container_id", "left_semi").join(outer, "id").groupBy("container_id").agg(F.min(F.struct((-F.col("n")).alias("k"), "id")).alias("x"))
    return ranked.select("container_id", F.col("x.id").alias("id"), (-F.col("x.k")).alias("n"))


def weakest_members(scores: DataFrame, most: int = 2) -> DataFrame:
    """The least certain members of each container, in order."""
    order = Window.partitionBy("container_id").orderBy("score", "id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("container_id", "id", "score", "rank")


def tested_by(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Number of test targets that depend on each container; tests by a tag or the end of their name."""
    tests = targets.where(F.array_contains("tags", "test") | F.lower("name").rlike("tests?$")).select(F.col("id").alias("source"))
    used = edges.join(tests, "source", "left_semi").join(targets.select(F.col("id").alias("target"), "container_id"), "target")
    return used.groupBy("container_id").agg(F.count_distinct("source").alias("tests"))


def anchors(members: DataFrame, edges: DataFrame, most: int = 3) -> DataFrame:
    """Files to read first, of ``path, size``: the smallest README, the smallest entry file, then those most members include.

    Of files of one size the first by its path.
    """
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    least = F.min(F.struct("size", "path")).alias("x")
    readme = members.where(name.startswith("readme")).agg(least).select(F.lit("readme").alias("why"), "x.path")
    entry = members.where(name.rlike(r"^(main|program|app|index)\.")).agg(least).select(F.lit("entry").alias("why"), "x.path")
    own = members.select(F.col("path").alias("_p"))
    inner = edges.where("src <> dst").join(own, F.col("src") == F.col("_p"), "left_semi").join(own, F.col("dst") == F.col("_p"), "left_semi")
    central = inner.groupBy(F.col("dst").alias("path")).agg(F.count_distinct("src").alias("n")).orderBy(F.desc("n"), "path").limit(most).select(F.lit("central").alias("why"), "path")
    return readme.unionByName(entry).where("path IS NOT NULL").unionByName(central)


def echoed(report_rows: DataFrame, members: DataFrame, accepted: list[str]) -> DataFrame:
    """Findings of a report about each container's members; those made from another model (``model_hash``) are left out."""
    return report_rows.where(F.col("model_hash").isin(accepted)).join(members.select(F.col("id").alias("element"), "container_id"), "element").select("container_id", "kind", "element", "severity")


def footprint(measured: DataFrame, targets: DataFrame, model_hash: str) -> DataFrame:
    """Size of each container's artifacts, and whether any was measured on another model."""
    joined = measured.join(targets.select("id", "container_id"), "id")
    return joined.groupBy("container_id").agg(F.sum("size").alias("size"), F.bool_or(F.col("model_hash") != model_hash).alias("stale"))


def category_budget(families: DataFrame, n_containers: int, n_cycles: int, least: int = 3, most: int = 12) -> DataFrame:
    """Candidates a category may list: by its distinct families, at most by the size of the model."""
    room = min(most, max(least, -(-(n_containers + n_cycles) // 4)))
    return families.groupBy("category").agg(F.least(F.lit(room), F.greatest(F.lit(least), F.count_distinct("family"))).cast("int").alias("cap"))
