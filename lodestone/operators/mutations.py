"""Plans for seeded changes of a model, role clusters, and the export of experiment rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodestone.functions import evidence as ev
from lodestone.operators import clusterings, propose, ranking


def starved_share(edges: DataFrame, coverage: DataFrame, targets: DataFrame, share: float) -> tuple[DataFrame, DataFrame]:
    """A model that lost its evidence of a spread share of its targets."""
    count = max(1, round(share * targets.count()))
    return clusterings.starve(edges, coverage, ranking.spread(targets.select("id"), count, ["id"]))


def additions(targets: DataFrame, count: int) -> DataFrame:
    """``id, name, container_id``: targets to add, at most ``count``, each beside one of as many targets spread over the model; known ids are left out."""
    placed = ranking.before(targets.select(F.col("id").alias("_at"), "container_id"), ["_at"])
    turn = F.explode(F.filter(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.floor(i * F.col("_total") / count) == F.col("_before")))
    named = placed.select(turn.alias("_k"), "container_id").select(F.concat(F.lit("synthetic:lib:added_"), F.col("_k").cast("string")).alias("id"), F.concat(F.lit("added_"), F.col("_k").cast("string")).alias("name"), "container_id")
    return named.join(targets.select("id"), "id", "left_anti")


def removable_edges(edges: DataFrame) -> DataFrame:
    """Declared edges: those whose removal a run can see."""
    return edges.where("is_declared_dependency").select("source", "target")


def removable_targets(targets: DataFrame, edges: DataFrame) -> DataFrame:
    """First-party targets with an edge in or out."""
    touched = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return targets.where("NOT external").join(touched, "id", "left_semi").select("id")


def renamable_targets(targets: DataFrame) -> DataFrame:
    """``id, new_id`` of first-party targets; no new id is taken."""
    named = targets.where("NOT external").select("id", F.concat("id", F.lit("_renamed")).alias("new_id"))
    return named.join(targets.select(F.col("id").alias("new_id")), "new_id", "left_anti").select("id", "new_id")


def mergeable_pairs(targets: DataFrame, edges: DataFrame) -> DataFrame:
    """``kept, merged``: first-party targets of one container that an edge joins, the smaller id is kept."""
    own = targets.where("NOT external").select("id", "container_id")
    a, b = own.select(F.col("id").alias("source"), F.col("container_id").alias("_a")), own.select(F.col("id").alias("target"), F.col("container_id").alias("_b"))
    inner = edges.where("source <> target").join(a, "source").join(b, "target").where("_a = _b")
    return inner.select(F.least("source", "target").alias("kept"), F.greatest("source", "target").alias("merged")).distinct()


def accepted_proposal(targets: DataFrame, edges: DataFrame, layers: tuple[str, ...] = ("directory",)) -> DataFrame:
    """``entity, label``: a proposal taken as it is; what it leaves out is grouped by its directory, else stands alone."""
    found = propose.proposal(targets, edges).select(F.col("id").alias("entity"), F.concat_ws(":", "signal", "name").alias("label"))
    rest = targets.select(F.col("id").alias("entity"), "path").join(found.select("entity"), "entity", "left_anti")
    folder = F.when(F.col("path").contains("/"), F.concat(F.lit("path:"), F.regexp_replace("path", "/[^/]*$", ""))).otherwise(F.concat(F.lit("own:"), "entity"))
    return found.unionByName(rest.select("entity", folder.alias("label")))


def by_role(targets: DataFrame, prefix: str = "sdk-role:") -> DataFrame:
    """``entity, label``: clusters by the first role tag in order; targets without one are "library"."""
    roles = F.array_sort(F.filter("tags", lambda t: t.startswith(prefix)))
    return targets.select(F.col("id").alias("entity"), F.coalesce(F.substring(F.get(roles, F.lit(0)), len(prefix) + 1, 10**6), F.lit("library")).alias("label"))


def exported(rows: DataFrame, allowed: dict[str, str], buckets: dict[str, list[float]]) -> DataFrame:
    """The allowed columns of experiment rows under their public names; numbers in ``buckets`` become ranges."""
    from lodestone.operators.summaries import bucket

    return rows.select(*((bucket(F.col(c), buckets[c]) if c in buckets else F.col(c)).alias(public) for c, public in allowed.items()))


def violations(rows: DataFrame, allowed: dict[str, list]) -> DataFrame:
    """``field, value`` of what an export must not hold: fields outside the list, and values not allowed in theirs."""
    parts = []
    for name in rows.columns:
        value = F.col(name).cast("string")
        if name not in allowed:
            parts.append(rows.select(F.lit(name).alias("field"), value.alias("value")))
        elif allowed[name]:
            parts.append(rows.where(value.isNotNull() & ~value.isin([str(v) for v in allowed[name]])).select(F.lit(name).alias("field"), value.alias("value")))
    if not parts:
        return rows.select(F.lit("").alias("field"), F.lit("").alias("value")).limit(0)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def element_payload(targets: DataFrame, fields: list[str], patterns: list[str], denied: list[str]) -> DataFrame:
    """``id`` and the given text fields of each target, redacted: what may leave for a model call."""
    from lodestone.functions.texts import redact

    return targets.select("id", *(redact(F.col(c).cast("string"), patterns, denied).alias(c) for c in fields if c != "id"))


def allowed_payloads(payloads: DataFrame, denied: list[str]) -> DataFrame:
    """``payloads`` if none of them holds a denied word; raises otherwise, so nothing leaves by mistake."""
    texts = [F.lower(F.col(c)) for c, kind in payloads.dtypes if kind == "string"]
    bad = F.lit(False)
    for word in denied:
        for text in texts:
            bad = bad | F.coalesce(text.contains(word.lower()), F.lit(False))
    if not payloads.where(bad).isEmpty():
        raise ValueError("a payload holds a denied word")
    return payloads


def unknown_citations(narratives: DataFrame, targets: DataFrame) -> DataFrame:
    """``id, cite`` of citations (``cites``, a list) that name no target or container."""
    known = targets.select(F.explode(F.array("id", "container_id")).alias("cite")).distinct()
    return narratives.select("id", F.explode("cites").alias("cite")).join(known, "cite", "left_anti").select("id", "cite").distinct()


def layers_of(edges: DataFrame) -> DataFrame:
    """``layer, edges``: how many edges each layer produced."""
    return edges.select(F.explode(ev.layers(F.col("evidence"))).alias("layer")).groupBy("layer").agg(F.count("*").alias("edges"))
