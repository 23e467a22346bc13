"""What-if changes of a model, its conformance with decisions, and comparisons of runs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from lodestone.functions import evidence as ev
from lodestone.operators import baseline, decisions, findings, govern, graph, lift, risk
from lodestone.session import materialise

# Severity of a layering finding, and titles that name a candidate rule.
LAYERING_SEVERITY = 0.9
RULE_TITLE = r"(?i)^(?:no|forbid|avoid|disallow)\s+(?:direct\s+)?(?:dependenc(?:y|ies)|references?|calls?)\s+from\s+(.+?)\s+to\s+(.+?)[.]?$"


def extract(targets: DataFrame, members: list[str], name: str) -> DataFrame:
    """Targets with some members in a container of their own."""
    return _moved(targets, F.col("id").isin(members), name)


def move(targets: DataFrame, members: list[str], to: str) -> DataFrame:
    """Targets with some members in another container, which must be there."""
    if targets.where(F.col("container_id") == to).isEmpty():
        raise ValueError(f"no container {to}")
    return _moved(targets, F.col("id").isin(members), to)


def _moved(targets: DataFrame, hit, container: str) -> DataFrame:
    if targets.where(hit).isEmpty():
        raise ValueError("no such members")
    return targets.withColumn("container_id", F.when(hit, container).otherwise(F.col("container_id")))


def apply(targets: DataFrame, edges: DataFrame, op: str, members: list[str] = (), name: str = "", source: str = "", target: str = "") -> tuple[DataFrame, DataFrame]:
    """Targets and edges after one of ``extract``, ``merge``, ``move`` (of members or containers, to ``name``) or ``cut`` (of an edge)."""
    if op == "extract":
        return extract(targets, list(members), name), edges
    if op == "move":
        return move(targets, list(members), name), edges
    if op == "merge":
        return risk.merge_containers(targets, list(members), name), edges
    if op == "cut":
        return targets, risk.cut_edges(edges, source, target)
    raise ValueError(f"unknown change {op}")


_COUNTS = ("edges", "weight", "containers", "max_fan_in", "max_fan_out", "cycles", "violations")


def metrics(targets: DataFrame, edges: DataFrame, coverage: DataFrame, rules: DataFrame, by: str) -> DataFrame:
    """A row of structure for each model of ``by``: edges, weight, containers, fans, cycles, violated rules.

    All models are lifted, searched for rings and checked together: rings never meet, for the names of
    their nodes begin with the model's.
    """
    lifted = materialise(lift.container_edges(edges, targets, (by,)), "lifted")
    node = lambda end: F.concat_ws("\x1f", F.col(by).cast("string"), end)
    rings = graph.strong_components(lifted.select(node("source_container").alias("source"), node("target_container").alias("target"))).select("component").distinct()
    rings = rings.groupBy(F.split_part("component", F.lit("\x1f"), F.lit(1)).cast(targets.schema[by].dataType).alias(by)).agg(F.count("*").alias("cycles"))
    broken = govern.check_layering(edges, targets, coverage, rules, (by,)).groupBy(by).agg(F.count_if(F.col("status") == "VIOLATION").alias("violations"))
    out = targets.select(by).distinct()
    for part in (risk.structural_metrics(lifted, (by,)), rings, broken):
        # A row a model.
        out = out.join(F.broadcast(part), by, "left")
    return out.select(by, *(F.coalesce(c, F.lit(0)).alias(c) for c in _COUNTS))


def simulate(targets: DataFrame, edges: DataFrame, coverage: DataFrame, rules: DataFrame, op: str, **change) -> DataFrame:
    """``metric, before, after, delta`` of a change; the model before and after it is measured in one go."""
    after = apply(targets, edges, op, **change)
    both = []
    for before, now, columns in ((targets, after[0], ["id", "container_id"]), (edges, after[1], ["source", "target", "weight", "is_declared_dependency", "confidence"])):
        both.append(before.select(F.lit("before").alias("side"), *columns).unionByName(now.select(F.lit("after").alias("side"), *columns)))
    sides = materialise(metrics(*both, coverage, rules, "side"), "metrics")
    return baseline.metric_delta(*(sides.where(F.col("side") == s).drop("side") for s in ("before", "after")))


def scenarios(targets: DataFrame, edges: DataFrame, hubs: DataFrame) -> DataFrame:
    """``finding, op, subject, other``: a cut of the weakest edge of each cycle, an extraction of the busiest member of each hub."""
    cuts = findings.weakest_cycle_edges(edges, graph.strong_components(edges)).select(F.col("component").alias("finding"), F.lit("cut").alias("op"), F.col("source").alias("subject"), F.col("target").alias("other"))
    out = findings.busiest_members(edges, targets).join(hubs.select(F.col("node").alias("container_id")), "container_id", "left_semi")
    return cuts.unionByName(out.select(F.col("container_id").alias("finding"), F.lit("extract").alias("op"), F.col("id").alias("subject"), F.lit(None).cast("string").alias("other")))


def layering_findings(edges: DataFrame, targets: DataFrame, coverage: DataFrame, rules: DataFrame) -> DataFrame:
    """``element, severity, n_edges`` of each violated rule."""
    hit = govern.check_layering(edges, targets, coverage, rules).where("status = 'VIOLATION'")
    return hit.select(F.col("rule").alias("element"), F.lit(LAYERING_SEVERITY).alias("severity"), "n_edges")


def dropped_below(before: DataFrame, now: DataFrame, floor: float = govern.COVERAGE_FLOOR) -> DataFrame:
    """``before, now, dropped``: whether coverage fell below the floor, or below what it was while it was under it."""
    joined = before.select(F.col("coverage").alias("before")).join(F.broadcast(now.select(F.col("coverage").alias("now"))))
    return joined.withColumn("dropped", (F.col("now") < F.col("before")) & (F.col("now") < floor))


def gate(layering: DataFrame, drift: DataFrame, coverage: DataFrame) -> DataFrame:
    """``violations, new_edges, advisory, blocked``: violations block, unless coverage makes the run advisory."""
    counted = layering.agg(F.count_if(F.col("status") == "VIOLATION").alias("violations"))
    fresh = drift.agg(F.count_if(F.col("status") == "new").alias("new_edges"))
    joined = counted.join(F.broadcast(fresh)).join(F.broadcast(coverage.select("advisory")))
    return joined.withColumn("blocked", (F.col("violations") > 0) & ~F.col("advisory"))


def rule_candidates(records: DataFrame) -> DataFrame:
    """``id, from, to`` of records whose title names a forbidden dependency."""
    side = lambda k: F.trim(F.regexp_extract("title", RULE_TITLE, k))
    return records.select("id", side(1).alias("from"), side(2).alias("to")).where("`from` <> '' AND `to` <> ''")


def conformance(records: DataFrame, targets: DataFrame, edges: DataFrame, coverage: DataFrame) -> DataFrame:
    """``id, from, to, verdict`` of each record's constraints, and of each record without one.

    HELD, VIOLATED or UNVERIFIED as the layering check finds, where both sides name an element or a
    container; constraints on anything else, and records without any, are NOT-A-CONSTRAINT.
    """
    found = decisions.constraints(records)
    # Constraints come without marks of emphasis, so names are compared without them too.
    key = lambda name: F.lower(F.regexp_replace(name, decisions.MARKS, "")).alias("k")
    tokens = [(F.col("name"), "id"), (F.col("id"), "id"), (F.col("container_id"), "container_id"), (F.regexp_replace("container_id", "^container:", ""), "container_id")]
    known = targets.select(F.explode(F.array(*(F.struct(key(name), F.col(c).alias("token")) for name, c in tokens))).alias("x")).select("x.*").groupBy("k").agg(F.min("token").alias("token"))
    named = found
    for end in ("from", "to"):
        named = named.join(known.select(F.col("k").alias(f"_{end}"), F.col("token").alias(f"{end}_token")), F.lower(end) == F.col(f"_{end}"), "left").drop(f"_{end}")
    both = named.where("from_token IS NOT NULL AND to_token IS NOT NULL").withColumn("rule", F.concat_ws("|", "id", "from", "to"))
    checked = govern.check_layering(edges, targets, coverage, both.select("rule", F.col("from_token").alias("from"), F.col("to_token").alias("to")))
    word = F.when(F.col("status") == "VIOLATION", "VIOLATED").when(F.col("status") == "OK", "HELD").otherwise("UNVERIFIED")
    judged = both.join(checked.select("rule", word.alias("verdict")), "rule").select("id", "from", "to", "verdict")
    open_ = named.where("from_token IS NULL OR to_token IS NULL").select("id", "from", "to", F.lit("NOT-A-CONSTRAINT").alias("verdict"))
    none = records.select("id").join(found.select("id"), "id", "left_anti").select("id", F.lit(None).cast("string").alias("from"), F.lit(None).cast("string").alias("to"), F.lit("NOT-A-CONSTRAINT").alias("verdict"))
    return judged.unionByName(open_).unionByName(none)


def scoped(drift: DataFrame, targets: DataFrame, coverage: DataFrame) -> DataFrame:
    """Findings on edges whose ends are both first-party and covered for L0."""
    own = targets.where("NOT external").select("id").join(coverage.where("layer = 'L0'").where(ev.covered(F.col("value"))).select("id"), "id", "left_semi")
    out = drift
    for end in ("source", "target"):
        out = out.join(own.select(F.col("id").alias(end)), end, "left_semi")
    return out


def evaluate_pair(before: DataFrame, after: DataFrame, targets: DataFrame, coverage: DataFrame, labels: DataFrame) -> DataFrame:
    """``label, findings``: drift between two releases within scope, by the label given to each edge ("unlabelled" without one)."""
    drift = scoped(govern.drift_edges(before, after, coverage), targets, coverage)
    return drift.join(labels, ["source", "target"], "left").groupBy(F.coalesce("label", F.lit("unlabelled")).alias("label"), "status").agg(F.count("*").alias("findings"))


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """``file, status``: same, different, only-a or only-b by the hashes of two runs' files."""
    both = a.select("file", F.col("hash").alias("_a")).join(b.select("file", F.col("hash").alias("_b")), "file", "full_outer")
    status = F.when(F.col("_a").isNull(), "only-b").when(F.col("_b").isNull(), "only-a").when(F.col("_a") == F.col("_b"), "same").otherwise("different")
    return both.select("file", status.alias("status"))


def reference_edges(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """``source_label, target_label`` of the edges between the clusters of a partition (``entity, label``)."""
    out = edges.select("source", "target")
    for end in ("source", "target"):
        out = out.join(partition.select(F.col("entity").alias(end), F.col("label").alias(f"{end}_label")), end)
    return out.where("source_label <> target_label").select("source_label", "target_label").distinct()


def migrate(version: str) -> str:
    """Models of version 1 stay as they are; any other is refused."""
    if not re.fullmatch(r"1(\.\d+)*", version or ""):
        raise ValueError(f"no migration from version {version}")
    return version
