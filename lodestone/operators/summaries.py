"""Summaries of a model: per layer, stratum, container and package, and the wide record of each container."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestone.functions import evidence as ev
from lodestone.operators import lift, score

# The largest model drawn with all its targets, and the elements of a view.
SMALL_MODEL, VIEW_BUDGET = 25, 25


def model_shape(targets: DataFrame, most: int = SMALL_MODEL, pinned: str | None = None) -> DataFrame:
    """``shape, first_party``: "y" for models of at most ``most`` first-party targets, else "x"; a pinned shape wins."""
    count = F.count_if(~F.col("external"))
    shape = F.lit(pinned) if pinned else F.when(count <= most, "y").otherwise("x")
    return targets.agg(shape.alias("shape"), count.alias("first_party"))


def view_budgets(members: DataFrame, view: str = "view", most: int = VIEW_BUDGET) -> DataFrame:
    """``view, elements, over`` of each view."""
    return members.groupBy(F.col(view).alias("view")).agg(F.count("*").alias("elements"), (F.count("*") > most).alias("over"))


def covers_layer(targets: DataFrame, coverage: DataFrame) -> DataFrame:
    """``layer, covers``: whether any first-party target is covered for the layer."""
    own = coverage.join(targets.where("NOT external").select("id"), "id", "left_semi")
    return own.groupBy("layer").agg(F.bool_or(ev.covered(F.col("value"))).alias("covers"))


def cited_edges(lifted: DataFrame, members: DataFrame, column: str = "node") -> DataFrame:
    """Container edges with both ends among ``members``, in order."""
    own = members.select(F.col(column).alias("_m")).distinct()
    inner = lifted.join(own, F.col("source_container") == F.col("_m"), "left_semi").join(own, F.col("target_container") == F.col("_m"), "left_semi")
    return inner.select("source_container", "target_container", "weight").orderBy("source_container", "target_container")


def model_summary(scores: DataFrame, threshold: float = score.THRESHOLD) -> DataFrame:
    """One row: elements, bands, mean, retained and abstained elements, area under the risk curve."""
    band = score.band(F.col("score"))
    counts = scores.agg(
        F.count("*").alias("elements"), *(F.count_if(band == b).alias(b) for b in ("high", "medium", "low")), F.round(F.avg("score"), 4).alias("mean"),
        F.count_if(F.col("score") >= threshold).alias("retained"), F.count_if(F.col("score") < threshold).alias("abstained"),
    )
    return counts.join(F.broadcast(score.aurc(score.risk_curve(scores))))


def container_strata(scores: DataFrame) -> DataFrame:
    """``container_id, stratum``: the strongest stratum of its members."""
    order = F.array_position(F.array(*map(F.lit, ("L0", "interop", "L1", "L2", "L3", "runtime", "none"))), F.col("stratum"))
    return scores.groupBy("container_id").agg(F.min_by("stratum", order).alias("stratum"))


def scorecard(scores: DataFrame, edges: DataFrame, coverage: DataFrame) -> DataFrame:
    """``stratum, elements, edges, abstained, partial, mean`` of each stratum, and of all under "total".

    An edge belongs to the stratum of its source; ``partial`` counts elements with a partly covered layer.
    """
    out = edges.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("_edges"))
    part = coverage.where(~F.col("value").isin("true", "false")).select("id", F.lit(1).alias("_part")).distinct()
    joined = scores.join(out, "id", "left").join(part, "id", "left")
    sums = joined.rollup("stratum").agg(
        F.count("*").alias("elements"), F.coalesce(F.sum("_edges"), F.lit(0)).alias("edges"), F.count_if(F.col("score") < score.THRESHOLD).alias("abstained"), F.count("_part").alias("partial"), F.round(F.avg("score"), 4).alias("mean"),
    )
    return sums.withColumn("stratum", F.coalesce("stratum", F.lit("total")))


def technologies(packages: DataFrame, most: int = 8) -> DataFrame:
    """``container_id, packages``: the distinct packages of its members in order, ``most`` of them at most."""
    names = packages.select("container_id", "package").distinct()
    ranked = names.withColumn("_r", F.row_number().over(Window.partitionBy("container_id").orderBy("package"))).where(F.col("_r") <= most)
    return ranked.groupBy("container_id").agg(F.array_sort(F.collect_list("package")).alias("packages"))


def dominant_signal(members: DataFrame, signal: str = "signal") -> DataFrame:
    """``container_id, signal``: what placed most members, ties to the smaller name; members without one don't count."""
    counted = members.where(F.col(signal).isNotNull()).groupBy("container_id", F.col(signal).alias("signal")).agg(F.count("*").alias("n"))
    return counted.groupBy("container_id").agg(F.min_by("signal", F.struct(-F.col("n"), "signal")).alias("signal"))


def language_rollup(measured: DataFrame) -> DataFrame:
    """``container_id, language, files, code``: a row per language, and one without for the container."""
    sums = measured.groupingSets([["container_id", "language"], ["container_id"]], "container_id", "language").agg(F.count("*").alias("files"), F.sum("code").alias("code"), F.grouping("language").alias("_all"))
    return sums.select("container_id", F.when(F.col("_all") == 1, "all").otherwise(F.coalesce("language", F.lit("unknown"))).alias("language"), "files", "code")


def annotated(targets: DataFrame, measured: DataFrame, fields: list[str]) -> DataFrame:
    """``targets`` with measured fields; a measured value overwrites, a missing one keeps what was there."""
    own = measured.select("id", *(F.col(c).alias(f"_{c}") for c in fields))
    joined = targets.join(own, "id", "left")
    values = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) if c in targets.columns else F.col(f"_{c}") for c in fields}
    return joined.withColumns(values).drop(*(f"_{c}" for c in fields))


def element_tags(external: Column, tags: Column, type_: Column) -> Column:
    """Sorted tags of an element: its own without those for grouping, its type, and whether it is external."""
    own = F.filter(tags, lambda t: ~t.contains(":") | t.startswith("seam:"))
    return F.array_sort(F.array_distinct(F.concat(own, F.array(F.concat(F.lit("type:"), F.coalesce(type_, F.lit("unknown")))), F.when(external, F.array(F.lit("external"))).otherwise(F.array().cast("array<string>")))))


def package_family(package: Column, families: list[tuple[str, str]], other: str | None = None) -> Column:
    """Family of the first text, in order, that a package's name holds."""
    out = F.lit(other)
    for text, family in reversed(families):
        out = F.when(package.contains(text), family).otherwise(out)
    return out


def bucket(value: Column, edges: list[float]) -> Column:
    """Label of the half-open range between two edges that holds the value."""
    label = F.when(value < edges[0], f"<{edges[0]}")
    for low, high in zip(edges, edges[1:]):
        label = label.when(value < high, f"{low}-{high}")
    return label.when(value.isNotNull(), f">={edges[-1]}")


def entries(targets: DataFrame, edges: DataFrame, roles: tuple[str, ...] = ("role:controller", "role:host", "type:executable")) -> DataFrame:
    """``container_id, reason, confidence``: containers that work starts in.

    Those with a member of an entry role, high confidence; then those that no other container uses, low.
    """
    role = F.array_intersect("tags", F.array(*map(F.lit, roles)))
    marked = targets.where(F.size(role) > 0).groupBy("container_id").agg(F.min(F.array_min(role)).alias("reason")).withColumn("confidence", F.lit("high"))
    used = lift.cross_edges(edges, targets).select(F.col("target_container").alias("container_id")).distinct()
    free = targets.where("NOT external").select("container_id").distinct().join(used, "container_id", "left_anti").join(marked, "container_id", "left_anti")
    return marked.unionByName(free.withColumns({"reason": F.lit("unused"), "confidence": F.lit("low")}))


def salient_members(targets: DataFrame, edges: DataFrame, sizes: DataFrame, most: int, seam_bonus: int = 5) -> DataFrame:
    """``container_id, id, rank``: members by users from any container (more for a seam), then size, then id."""
    fan = edges.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("_fan"))
    seams = edges.where(F.exists("evidence", lambda e: e["type"] == "interop")).select(F.explode(F.array("source", "target")).alias("id")).distinct().withColumn("_seam", F.lit(seam_bonus))
    joined = targets.join(fan, "id", "left").join(seams, "id", "left").join(sizes.select("id", F.col("size").alias("_size")), "id", "left")
    weight = F.coalesce("_fan", F.lit(0)) + F.coalesce("_seam", F.lit(0))
    order = Window.partitionBy("container_id").orderBy(weight.desc(), F.coalesce("_size", F.lit(0)).desc(), "id")
    return joined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("container_id", "id", "rank")


def churn(commits: DataFrame, coupling: DataFrame, days: int = 90) -> DataFrame:
    """``container_id, commits, degree, hotspot`` of the last ``days`` before the newest commit.

    The hotspot is the product of both counts, each as a part of its maximum.
    """
    head = F.broadcast(commits.agg(F.max("ts").alias("_head")))
    recent = commits.join(head, F.col("ts") >= F.col("_head") - F.expr(f"INTERVAL {days} DAYS"))
    counted = recent.groupBy("container_id").agg(F.count("*").alias("commits")).join(coupling.select("container_id", "degree"), "container_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    top = F.broadcast(counted.agg(F.max("commits").alias("_c"), F.max("degree").alias("_d")))
    return counted.join(top).select("container_id", "commits", "degree", F.round(F.col("commits") / F.col("_c") * F.coalesce(F.try_divide("degree", "_d"), F.lit(0.0)), 4).alias("hotspot"))


def sweep(edges: DataFrame, targets: DataFrame, thresholds: list[int] = (0, 1, 3, 5, 8), ceilings: list[str] = ("L0", "L1", "L2", "L3")) -> DataFrame:
    """``ceiling, threshold, edges, container_pairs``: what each layer ceiling and weight threshold leave."""
    items = edges.select("source", "target", F.explode("evidence").alias("e"))
    rank = {c: k for k, c in enumerate(("L0", "L1", "L2", "L3"))}
    levels = F.explode(F.array(*(F.struct(F.lit(c).alias("ceiling"), F.lit(rank[c]).alias("_k")) for c in ceilings)))
    kept = items.select("*", levels.alias("c")).where(ev.layer_rank(F.col("e.type")) <= F.col("c._k"))
    private = F.sum((F.col("e.visibility") == "private").cast("long"))
    weighed = kept.groupBy("source", "target", F.col("c.ceiling").alias("ceiling")).agg(F.greatest(F.lit(0), F.sum(ev.item_weight(F.col("e.type"), F.col("e.count"))) - ev.PRIVATE_CUT * F.coalesce(private, F.lit(0))).alias("weight"))
    lifted = lift.cross_edges(weighed, targets).withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).where("weight >= threshold")
    return lifted.groupBy("ceiling", "threshold").agg(F.count("*").alias("edges"), F.count_distinct("source_container", "target_container").alias("container_pairs"))


def context(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """``id, uses, used_by``: the other containers that each target uses, and those that use it, in order."""
    crossing = lift.cross_edges(edges, targets)
    ends = crossing.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.col("target_container").alias("uses"), F.lit(None).cast("string").alias("used_by")), F.struct(F.col("target").alias("id"), F.lit(None).cast("string").alias("uses"), F.col("source_container").alias("used_by")))).alias("x")).select("x.*")
    return ends.groupBy("id").agg(F.array_sort(F.collect_set("uses")).alias("uses"), F.array_sort(F.collect_set("used_by")).alias("used_by"))


def crosschecked(targets: DataFrame, edges: DataFrame, stated: DataFrame) -> DataFrame:
    """``id, evidence, review, tags``: a stated low confidence or weak evidence asks for review and curation."""
    near = score.incident(edges).groupBy("id").agg(F.sum("n_items").alias("_n"))
    joined = targets.join(near, "id", "left").join(stated.select("id", F.col("confidence").alias("_stated")), "id", "left")
    weak = (F.coalesce("_n", F.lit(0)) < 2) | (~F.col("documented") & F.array_contains("tags", "needs-curation"))
    review = weak | F.coalesce(F.col("_stated") == "low", F.lit(False))
    tags = F.when(review, F.array_union("tags", F.array(F.lit("needs-curation")))).otherwise(F.col("tags"))
    return joined.select("id", F.when(weak, "weak").otherwise("strong").alias("evidence"), review.alias("review"), tags.alias("tags"))


def datasheets(targets: DataFrame, edges: DataFrame, coverage: DataFrame, packages: DataFrame, measured: DataFrame, risks: DataFrame) -> DataFrame:
    """The wide record of each container: size, degree, confidence, stratum, technology, signal, languages, tests, risks.

    ``targets`` also has ``signal``; ``packages`` is ``container_id, package``, ``measured`` is
    ``container_id, language, code``, ``risks`` is ``container_id, severity``. What a container lacks is null.
    """
    scores = score.element_scores(targets, edges)
    base = lift.containers(targets).select("container_id", "members", "boundary")
    degree = lift.degree(lift.container_edges(edges, targets)).select(F.col("node").alias("container_id"), "efferent", "afferent", "weight")
    largest = language_rollup(measured)
    code = largest.where("language = 'all'").select("container_id", F.col("code").alias("code"))
    main = largest.where("language <> 'all'").groupBy("container_id").agg(F.min_by("language", F.struct(-F.col("code"), "language")).alias("language"))
    seen = coverage.where("layer = 'L0'").join(targets.where("NOT external").select("id", "container_id"), "id").groupBy("container_id").agg(F.round(F.avg(ev.covered(F.col("value")).cast("double")), 4).alias("coverage"))
    parts = [
        degree, score.container_scores(scores).select("container_id", F.col("mean").alias("confidence"), "abstained"), container_strata(scores), technologies(packages), dominant_signal(targets), code, main, seen,
        risks.groupBy("container_id").agg(F.count("*").alias("risks"), F.max("severity").alias("worst")),
    ]
    for part in parts:
        base = base.join(part, "container_id", "left")
    return base
