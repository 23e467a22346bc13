"""Seeded changes of a model: many variants planned, applied and judged in one job.

A plan is a table ``variant, operator, a, b``. Each variant is the base model with one change; all of
them are made by one expression over the base's rows and the plan's, with the variant as part of every
key, and their drift, renames and layering are found together. What is found is held against what the
change must show. Findings count within the first-party build graph: first-party targets, and edges
between them that a build file declares.

``add_forbidden_dep`` a new edge a -> b that a rule forbids; ``remove_dep`` an edge; ``add_target`` a;
``remove_target`` a with its edges; ``rename_target`` a to b; ``merge_targets`` a into b: who needed a
needs b, and a's own needs go.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lodestone.functions import evidence as ev
from lodestone.operators import govern, ranking
from lodestone.session import materialise

_KEYS = ("variant",)
_FINDING = ["variant", "kind", "x", "y"]
#: Evidence that comes from elsewhere than build files.
_NOISY = ("interop", "runtime")


def first_party_edges(targets: DataFrame, edges: DataFrame) -> DataFrame:
    """``source, target`` of declared edges between first-party targets."""
    own = targets.where("NOT external").select("id")
    out = edges.where(F.exists("evidence", lambda e: ev.layer(e["type"]) == "L0")).select("source", "target")
    for end in ("source", "target"):
        out = out.join(own.withColumnRenamed("id", end), end, "left_semi")
    return out.select("source", "target").distinct()


def _either_end(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()


def _clean(targets: DataFrame, edges: DataFrame) -> DataFrame:
    """First-party targets whose edges all come from build files or code."""
    noisy = _either_end(edges.where(F.exists("evidence", lambda e: e["type"].isin(*_NOISY))))
    return targets.where("NOT external").select("id").join(noisy, "id", "left_anti")


def absent_pairs(targets: DataFrame, own: DataFrame, n: int) -> DataFrame:
    """``a, b``: ``n`` first-party pairs without an edge either way, at least one of them in the graph, at even distances.

    Pairs are counted, never listed: of each a the number of its b, by whose sums a pick finds its a; then
    the ranks that a can't have tell which target is its k-th.
    """
    known = materialise(ranking.before(targets.where("NOT external").select("id"), ["id"]).select("id", F.col("_before").alias("rank"), F.col("_total").alias("total")), "ranks")
    used = _either_end(own)
    ranked_used = materialise(ranking.before(used, ["id"]).select("id", F.col("_before").alias("used_rank"), F.col("_total").alias("n_used")), "ranks")
    turned = own.select(F.col("target").alias("source"), F.col("source").alias("target"))
    near = own.unionByName(turned).where("source <> target").distinct()
    taken = near.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("degree"))
    n_used = ranked_used.agg(F.coalesce(F.max("n_used"), F.lit(0)).alias("n_used"))
    count = F.when(F.col("used_rank").isNotNull(), F.col("total") - 1 - F.coalesce("degree", F.lit(0))).otherwise(F.col("n_all_used"))
    rows = known.join(ranked_used.drop("n_used"), "id", "left").join(taken, "id", "left").join(F.broadcast(n_used.withColumnRenamed("n_used", "n_all_used"))).withColumn("count", count)
    placed = ranking.before(rows, ["id"], F.col("count"))
    picks = F.filter(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * F.col("_total") / n))), lambda k: (k >= F.col("_before")) & (k < F.col("_before") + F.col("count")))
    picked = materialise(placed.withColumn("k", F.explode(picks)).select("id", "rank", "used_rank", (F.col("k") - F.col("_before")).alias("k")), "picks")
    barred = near.join(picked.select(F.col("id").alias("source")).distinct(), "source").join(known.select(F.col("id").alias("target"), F.col("rank").alias("_r")), "target")
    barred = barred.groupBy(F.col("source").alias("id")).agg(F.collect_list("_r").alias("_barred"))
    inner = picked.where("used_rank IS NOT NULL").join(barred, "id", "left")
    ranks = F.array_sort(F.array_append(F.coalesce("_barred", F.array().cast("array<bigint>")), F.col("rank")))
    skipped = F.size(F.filter(F.transform(ranks, lambda r, i: r - i), lambda r: r <= F.col("k")))
    first = inner.select(F.col("id").alias("a"), (F.col("k") + skipped).alias("rank")).join(known.select("rank", F.col("id").alias("b")), "rank")
    rest = picked.where("used_rank IS NULL").select(F.col("id").alias("a"), F.col("k").alias("used_rank")).join(ranked_used.select("used_rank", F.col("id").alias("b")), "used_rank")
    return first.select("a", "b").unionByName(rest.select("a", "b"))


def plan(targets: DataFrame, edges: DataFrame, instances: int = 4) -> DataFrame:
    """``variant, operator, a, b``: up to ``instances`` changes of each operator, spread over its candidates in order."""
    own = materialise(first_party_edges(targets, edges), "own")
    touched, clean = _either_end(own), _clean(targets, edges)
    none = F.lit(None).cast("string")
    degree = own.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n"))
    # The two that most others need: every target is merged into the first of them that is not itself.
    first_party = targets.where("NOT external").select("id").join(degree, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))
    top = first_party.orderBy(F.desc("n"), "id").limit(2).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "id"))).alias("top"))
    merged = clean.join(degree, "id", "left_semi").join(F.broadcast(top)).withColumn("b", F.element_at(F.filter(F.transform("top", lambda x: x["id"]), lambda x: x != F.col("id")), 1))
    names = targets.sparkSession.range(instances).select(F.concat(F.lit("synthetic:lib:added_"), F.col("id") + 1).alias("id"))
    candidates = {
        "add_forbidden_dep": absent_pairs(targets, own, instances),
        "remove_dep": ranking.spread(own, instances, ["source", "target"]).select(F.col("source").alias("a"), F.col("target").alias("b")),
        "add_target": names.join(targets, "id", "left_anti").select(F.col("id").alias("a"), none.alias("b")),
        "remove_target": ranking.spread(clean.join(touched, "id", "left_semi"), instances, ["id"]).select(F.col("id").alias("a"), none.alias("b")),
        "rename_target": ranking.spread(clean.join(touched, "id", "left_semi"), instances, ["id"]).select(F.col("id").alias("a"), F.concat("id", F.lit("_renamed")).alias("b")),
        "merge_targets": ranking.spread(merged.where("b IS NOT NULL").select("id", "b"), instances, ["id"]).select(F.col("id").alias("a"), "b"),
    }
    out = None
    for name, rows in candidates.items():
        rows = rows.select(F.lit(name).alias("operator"), "a", "b")
        out = rows if out is None else out.unionByName(rows)
    # At most ``instances`` rows an operator.
    rows = out.agg(F.array_sort(F.collect_list(F.struct("operator", "a", "b"))).alias("x"))
    return materialise(rows.select(F.posexplode("x").alias("variant", "x")).select(F.col("variant").cast("long").alias("variant"), "x.*"), "plan")


@dataclass
class Variants:
    """All variants of a model, and the base once for each of them."""

    targets: DataFrame
    edges: DataFrame
    base_targets: DataFrame
    base_edges: DataFrame


def _is(*operators: str) -> Column:
    return F.col("operator").isin(*operators)


def applied(targets: DataFrame, edges: DataFrame, changes: DataFrame) -> Variants:
    """Every change applied to the model, the variant in each row. Only the plan, of a known number of rows, is broadcast."""
    each = F.broadcast(changes)
    base_targets = targets.select("id", "container_id", "external").join(each)
    gone = _is("remove_target", "merge_targets") & (F.col("id") == F.col("a"))
    new_id = F.when(_is("rename_target") & (F.col("id") == F.col("a")), F.col("b")).otherwise(F.col("id"))
    kept = base_targets.where(~gone).select("variant", new_id.alias("id"), "container_id", "external")
    added = changes.where(_is("add_target")).select("variant", F.col("a").alias("id"), F.lit("container:added").alias("container_id"), F.lit(False).alias("external"))
    base_edges = edges.select("source", "target", "evidence").join(each)
    source, target, a, b = map(F.col, ("source", "target", "a", "b"))
    cut = (_is("remove_dep") & (source == a) & (target == b)) | (_is("remove_target") & ((source == a) | (target == a))) | (_is("merge_targets") & (source == a))
    renamed = lambda end: F.when(_is("rename_target") & (end == a), b).otherwise(end)
    moved = F.when(_is("merge_targets") & (target == a), b).otherwise(renamed(target))
    # Who was merged with what it needed would need itself: that edge goes.
    left = base_edges.where(~cut & ~(_is("merge_targets") & (target == a) & (source == b)))
    left = left.select("variant", renamed(source).alias("source"), moved.alias("target"), ev.declared(F.col("evidence")).alias("declared"))
    new = changes.where(_is("add_forbidden_dep")).select("variant", a.alias("source"), b.alias("target"), F.lit(True).alias("declared"))
    now = left.unionByName(new).groupBy("variant", "source", "target").agg(F.bool_or("declared").alias("declared"))
    return Variants(kept.unionByName(added), now, base_targets.select("variant", "id", "container_id", "external"), base_edges.select("variant", "source", "target", "evidence"))


def _found(kind: str, rows: DataFrame, x: Column, y: Column) -> DataFrame:
    return rows.select("variant", F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"))


def _all(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def expected(own: DataFrame, changes: DataFrame) -> DataFrame:
    """``variant, kind, x, y`` that each change must show. ``own`` are the first-party declared edges."""
    a, b, none = F.col("a"), F.col("b"), F.lit(None).cast("string")
    source, target = F.col("source"), F.col("target")
    at = own.join(F.broadcast(changes.where(_is("remove_target", "rename_target", "merge_targets"))), (source == a) | (target == a))
    swapped = lambda end: F.when(end == a, b).otherwise(end)
    moved = at.where(_is("merge_targets") & (target == a) & (source != a) & (source != b)).select("variant", source.alias("source"), b.alias("target"))
    return _all(
        _found("new_target", changes.where(_is("add_target")), a, none),
        _found("new_target", changes.where(_is("rename_target")), b, none),
        _found("removed_target", changes.where(_is("remove_target", "rename_target", "merge_targets")), a, none),
        _found("removed_edge", changes.where(_is("remove_dep")), a, b),
        _found("removed_edge", at, source, target),
        _found("new_edge", changes.where(_is("add_forbidden_dep")), a, b),
        _found("new_edge", at.where(_is("rename_target")), swapped(source), swapped(target)),
        _found("new_edge", moved.join(own, ["source", "target"], "left_anti"), source, target),
        _found("rename", changes.where(_is("rename_target")), a, b),
        _found("violation", changes.where(_is("add_forbidden_dep")), a, b),
    )


def _drift(variants: Variants, coverage: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drift of the first-party targets and of the declared edges between first-party targets, of all variants."""
    own = lambda rows: rows.where("NOT external").select("variant", "id")
    before, now = own(variants.base_targets), own(variants.targets)

    def inside(edges: DataFrame, targets: DataFrame) -> DataFrame:
        for end in ("source", "target"):
            edges = edges.join(targets.select("variant", F.col("id").alias(end)), ["variant", end], "left_semi")
        return edges

    declared = variants.base_edges.where(F.exists("evidence", lambda e: ev.layer(e["type"]) == "L0"))
    targets = govern.drift_targets(before, now, coverage, _KEYS)
    edges = govern.drift_edges(inside(declared, before), inside(variants.edges.where("declared"), now), coverage, _KEYS)
    return materialise(targets, "drift"), materialise(edges, "drift")


def outcomes(targets: DataFrame, edges: DataFrame, coverage: DataFrame, rules: DataFrame, changes: DataFrame) -> DataFrame:
    """``variant, operator, kind, x, y, outcome`` of every finding of every variant.

    ``detected``: it had to show and does; ``gap``: it only shows as a gap of coverage, which is no drift;
    ``silent``: it does not show; ``alarm``: it shows though nothing asks for it. A rule that an expected
    new edge breaks beside the one that was meant is a right finding of that edge and not listed.
    """
    own = materialise(first_party_edges(targets, edges), "own")
    variants = applied(targets, edges, changes)
    drift, edge_drift = _drift(variants, coverage)
    want = expected(own, changes)
    planted = changes.where(_is("add_forbidden_dep")).select(F.concat(F.lit("seeded-"), "variant").alias("rule"), F.col("a").alias("from"), F.col("b").alias("to"))
    all_rules = rules.select("rule", "from", "to").unionByName(planted)
    # All rules hold in every variant, the planted ones too, so only what a change breaks is new.
    broken_before = govern.offending_edges(edges, targets, all_rules).select("rule").distinct()
    offending = govern.offending_edges(variants.edges, variants.targets, all_rules, _KEYS).join(broken_before, "rule", "left_anti")
    new_edges = want.where("kind = 'new_edge'").select("variant", F.col("x").alias("source"), F.col("y").alias("target"), F.lit(True).alias("_meant"))
    broken = offending.join(new_edges, ["variant", "source", "target"], "left").groupBy("variant", "rule").agg(F.bool_or(F.coalesce("_meant", F.lit(False))).alias("meant"))
    broken = broken.join(all_rules, "rule").select("variant", "from", "to", "meant")
    meant = want.where("kind = 'violation'").select("variant", F.col("x").alias("from"), F.col("y").alias("to"), F.lit(True).alias("_own"))
    violations = broken.join(meant, ["variant", "from", "to"], "left").where("_own OR NOT meant")
    none = F.lit(None).cast("string")
    status = F.col("status")
    found = _all(
        _found("new_target", drift.where(status == "new"), F.col("id"), none),
        _found("removed_target", drift.where(status == "removed"), F.col("id"), none),
        _found("new_edge", edge_drift.where(status == "new"), F.col("source"), F.col("target")),
        _found("removed_edge", edge_drift.where(status == "removed"), F.col("source"), F.col("target")),
        _found("rename", govern.suspected_renames(drift, _KEYS), F.col("old_id"), F.col("new_id")),
        _found("violation", violations, F.col("from"), F.col("to")),
    )
    gaps = _all(
        _found("removed_target", drift.where(status == "coverage-gap"), F.col("id"), none),
        _found("removed_edge", edge_drift.where(status == "coverage-gap"), F.col("source"), F.col("target")),
    )
    key = [F.col("variant"), F.col("kind"), F.col("x"), F.coalesce("y", F.lit("")).alias("y")]
    joined = want.select(*key, F.lit(True).alias("_want")).join(found.select(*key, F.lit(True).alias("_found")), _FINDING, "full_outer").join(gaps.select(*key, F.lit(True).alias("_gap")), _FINDING, "left")
    outcome = F.when(F.col("_want").isNull(), "alarm").when(F.col("_found"), "detected").when(F.col("_gap"), "gap").otherwise("silent")
    return joined.join(F.broadcast(changes.select("variant", "operator")), "variant").select("variant", "operator", "kind", "x", F.nullif(F.col("y"), F.lit("")).alias("y"), outcome.alias("outcome"))


def tally(found: DataFrame) -> DataFrame:
    """``operator, kind, detected, gap, silent, alarm`` of the findings of all variants."""
    return found.groupBy("operator", "kind").agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("detected", "gap", "silent", "alarm")))


def runs(found: DataFrame, changes: DataFrame) -> DataFrame:
    """``operator, variants, complete, clean, renames_right``: how many variants there are, show all they must, show nothing else, and classify renames rightly.

    A rename is right where it is found as one; any other change is right where none is suspected.
    """
    asked = F.col("outcome") != "alarm"
    of_rename = F.col("kind") == "rename"
    by = found.groupBy("variant").agg(
        F.bool_and(~asked | (F.col("outcome") == "detected")).alias("complete"),
        F.bool_and(asked).alias("clean"),
        F.count_if(of_rename & asked & (F.col("outcome") == "detected")).alias("_renamed"),
        F.count_if(of_rename & ~asked).alias("_suspected"),
    )
    right = F.when(_is("rename_target"), F.col("_renamed") > 0).otherwise(F.coalesce("_suspected", F.lit(0)) == 0)
    joined = changes.join(by, "variant", "left")
    return joined.groupBy("operator").agg(F.count("*").alias("variants"), F.count_if(F.coalesce("complete", F.lit(True))).alias("complete"), F.count_if(F.coalesce("clean", F.lit(True))).alias("clean"), F.count_if(right).alias("renames_right"))


def aliased(targets: DataFrame, edges: DataFrame, coverage: DataFrame, changes: DataFrame) -> DataFrame:
    """``variant, findings``: drift left of each rename once the new id is an alias of the old one; none should be."""
    renames = changes.where(_is("rename_target"))
    variants = applied(targets, edges, renames)
    # A row a rename.
    alias = F.broadcast(renames.select("variant", F.col("b").alias("_new"), F.col("a").alias("_old")))
    back = lambda rows, end: rows.join(alias.withColumnRenamed("_new", end), ["variant", end], "left").withColumn(end, F.coalesce("_old", end)).drop("_old")
    fixed = Variants(back(variants.targets, "id"), back(back(variants.edges, "source"), "target"), variants.base_targets, variants.base_edges)
    drift, edge_drift = _drift(fixed, coverage)
    left = drift.where("status <> 'coverage-gap'").select("variant").unionByName(edge_drift.where("status <> 'coverage-gap'").select("variant"))
    return renames.select("variant").join(left.groupBy("variant").agg(F.count("*").alias("n")), "variant", "left").select("variant", F.coalesce("n", F.lit(0)).alias("findings"))
