"""Scenarios: ordered steps held against build and runtime edges, entries, and walks from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lodestone.operators import sequences
from lodestone.session import materialise

# Salience of a seam, a boundary and an entry; steps of a walk.
SEAM, BOUNDARY, ENTRY, WALK = 10, 5, 10, 25


def labels(targets: DataFrame) -> DataFrame:
    """``label, container_id``: container ids first, then target names, then target ids; the first of a label wins."""
    rows = targets.select("id", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("container_id").alias("label")), F.struct(F.lit(1).alias("k"), F.col("name").alias("label")), F.struct(F.lit(2).alias("k"), F.col("id").alias("label")))).alias("x"), "container_id")
    return rows.groupBy(F.col("x.label").alias("label")).agg(F.min_by("container_id", F.struct("x.k", "id")).alias("container_id"))


def dynamic_view(steps: DataFrame, targets: DataFrame, build: DataFrame, runtime: DataFrame) -> DataFrame:
    """Each step (``key, index, from, to``) with its status and layer; build evidence wins, runtime has no weight."""
    named = labels(targets)
    for end in ("from", "to"):
        steps = steps.join(named.select(F.col("label").alias(end), F.col("container_id").alias(f"{end}_id")), end, "left")
    b = build.select(F.col("source_container").alias("from_id"), F.col("target_container").alias("to_id"), F.col("weight").alias("_w"))
    r = runtime.select(F.col("source_container").alias("from_id"), F.col("target_container").alias("to_id"), F.lit(True).alias("_r")).distinct()
    joined = steps.join(b, ["from_id", "to_id"], "left").join(r, ["from_id", "to_id"], "left")
    layer = F.when(F.col("_w").isNotNull(), "build").when(F.col("_r"), "runtime")
    status = F.when(F.col("from_id").isNull() | F.col("to_id").isNull(), "unresolved").when(layer.isNull(), "unevidenced").otherwise("ok")
    return joined.select("key", "index", "from", "to", status.alias("status"), layer.alias("evidence_layer"), F.col("_w").alias("weight"))


def indegree(build: DataFrame, runtime: DataFrame) -> DataFrame:
    pairs = build.select("source_container", "target_container").union(runtime.select("source_container", "target_container")).distinct()
    return pairs.groupBy(F.col("target_container").alias("container_id")).agg(F.count("*").alias("n"))


def edge_salience(weight, seam, boundary):
    return weight + F.when(seam, SEAM).otherwise(0) + F.when(boundary, BOUNDARY).otherwise(0)


def walk(build: DataFrame, entries: DataFrame, most: int = WALK) -> DataFrame:
    """Breadth-first steps from each entry: each node once, from its smallest parent; ``most`` steps an entry."""
    build = materialise(build.select("source_container", "target_container").distinct(), "pairs")
    seen = materialise(entries.select(F.col("container_id").alias("entry"), F.col("container_id").alias("node")).distinct(), "entries")
    frontier, out, level = seen, None, 0
    while True:
        level += 1
        found = frontier.join(build, F.col("node") == F.col("source_container")).select("entry", F.col("source_container").alias("from"), F.col("target_container").alias("node"))
        fresh = found.join(seen, ["entry", "node"], "left_anti").groupBy("entry", "node").agg(F.min("from").alias("from"))
        step = materialise(fresh.withColumn("level", F.lit(level)), "walk")
        if step.isEmpty():
            break
        out = step if out is None else out.unionByName(step)
        seen = seen.unionByName(step.select("entry", "node"))
        frontier = step.select("entry", "node")
    if out is None:
        return found.select("entry", F.lit(0).alias("index"), "from", F.col("node").alias("to")).where(F.lit(False))
    order = Window.partitionBy("entry").orderBy("level", "from", "node")
    return out.withColumn("index", F.row_number().over(order)).where(F.col("index") <= most).select("entry", "index", "from", F.col("node").alias("to"))


def runtime_walk(calls: DataFrame) -> DataFrame:
    """Steps from each caller that none calls: every edge once, those of a level share their order."""
    edges = materialise(calls.select(F.col("source_container").alias("a"), F.col("target_container").alias("b")).distinct(), "calls")
    roots = edges.select(F.col("a").alias("entry")).distinct().join(edges.select(F.col("b").alias("entry")).distinct(), "entry", "left_anti")
    frontier = roots.select("entry", F.col("entry").alias("node"))
    seen, level = None, 0
    while True:
        level += 1
        found = frontier.join(edges, F.col("node") == F.col("a")).select("entry", "a", "b").distinct()
        fresh = found if seen is None else found.join(seen.select("entry", "a", "b"), ["entry", "a", "b"], "left_anti")
        step = materialise(fresh.withColumn("order", F.lit(level)), "runtime")
        if step.isEmpty():
            break
        seen = step if seen is None else seen.unionByName(step)
        frontier = step.select("entry", F.col("b").alias("node")).distinct()
    empty = found.withColumn("order", F.lit(0)).where(F.lit(False))
    return (empty if seen is None else seen).select("entry", "order", F.col("a").alias("from"), F.col("b").alias("to"))


def collapsed_hops(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """Hops of ordered calls (``key, position, container_id``): repeats in a row are one, hops without an edge go."""
    order = Window.partitionBy("key").orderBy("position")
    once = calls.withColumn("_before", F.lag("container_id").over(order)).where(F.col("_before").isNull() | (F.col("_before") != F.col("container_id"))).drop("_before")
    hops = once.withColumn("to", F.lead("container_id").over(order)).where("to IS NOT NULL").select("key", "position", F.col("container_id").alias("from"), "to")
    return hops.join(edges.select(F.col("source_container").alias("from"), F.col("target_container").alias("to")).distinct(), ["from", "to"], "left_semi")


def mined(calls: DataFrame, targets: DataFrame, edges: DataFrame) -> DataFrame:
    """``path, key, name, index, from, to, description``: scenario steps that tests show, over edges of the model only.

    ``calls`` are ``path, position, receiver``: the receivers of a test's calls in their order. Those that
    are labels of the model become containers, others are passed over; calls to one container in a row are
    one; of two containers in a row a step is made if an edge (``source_container, target_container``) leads
    from the first to the second, and none is invented. A test without a step has no row.
    """
    placed = calls.join(labels(targets).withColumnRenamed("label", "receiver"), "receiver").select("path", "position", "container_id")
    found = sequences.hops(placed, ["path"], ["position"], "container_id")
    real = edges.select(F.col("source_container").alias("from"), F.col("target_container").alias("to")).distinct()
    steps = sequences.numbered(found.join(real, ["from", "to"], "left_semi").select("path", "position", "from", "to"), ["path"], ["position"])
    file = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(file, r"\.[^.]*$", "")
    slug = F.lower(F.trim(F.regexp_replace(stem, "[^A-Za-z0-9]+", "-"), F.lit("-")))
    return steps.select("path", F.concat(F.lit("test-"), slug).alias("key"), F.concat(F.lit("Test-derived: "), stem).alias("name"), F.col("index").cast("int").alias("index"), "from", "to", F.concat(F.lit("Observed in test "), file).alias("description"))
