"""Curation: exclusion, grouping, boundary promotion, kinds, down-weighting and the weight threshold."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from lodestone.functions import evidence as ev
from lodestone.functions.identifiers import glob


@dataclass
class Group:
    container: str
    members: list[str] = field(default_factory=list)
    globs: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)


@dataclass
class Rules:
    exclude: list[str] = field(default_factory=list)
    exclude_ids: list[str] = field(default_factory=list)
    groups: list[Group] = field(default_factory=list)
    kinds: list[tuple[str, str]] = field(default_factory=list)
    boundary: dict[str, str] = field(default_factory=dict)
    min_weight: int = 3
    drop_external: bool = True
    down_weight_private: bool = True


def matches(pattern: str) -> Column:
    """A shell pattern against a target's id, path or name."""
    return glob(F.col("id"), pattern) | glob(F.col("path"), pattern) | glob(F.col("name"), pattern)


def tag_matches(pattern: str) -> Column:
    return F.exists("tags", lambda t: glob(t, pattern))


def exclude(targets: DataFrame, rules: Rules) -> DataFrame:
    gone = F.col("id").isin(rules.exclude_ids) if rules.exclude_ids else F.lit(False)
    for pattern in rules.exclude:
        gone = gone | matches(pattern)
    return targets.where(~gone)


def group(targets: DataFrame, rules: Rules) -> DataFrame:
    """``grouped_by`` (signal, rule index, pattern) and ``group_name`` of each target.

    Explicit members win over patterns, and of rules that repeat a member the last; of patterns the
    first rule wins, its globs before its tags. Rules are few, so they are one expression, no join.
    """
    def outcome(signal: str, index: int, pattern: str) -> Column:
        return F.struct(F.lit(signal).alias("signal"), F.lit(index).alias("rule_index"), F.lit(pattern).alias("pattern"), F.lit(rules.groups[index].container).alias("container"))

    nothing = F.lit(None).cast("struct<signal:string,rule_index:int,pattern:string,container:string>")
    chosen = nothing
    for index in range(len(rules.groups) - 1, -1, -1):
        for pattern in reversed(rules.groups[index].tags):
            chosen = F.when(tag_matches(pattern), outcome("tag", index, pattern)).otherwise(chosen)
        for pattern in reversed(rules.groups[index].globs):
            chosen = F.when(matches(pattern), outcome("glob", index, pattern)).otherwise(chosen)
    for index, rule in enumerate(rules.groups):
        for member in rule.members:
            chosen = F.when(F.col("id") == member, outcome("member", index, member)).otherwise(chosen)
    return targets.withColumn("grouped_by", chosen).withColumn("group_name", F.col("grouped_by.container"))


def container_id(name: Column) -> Column:
    return F.concat(F.lit("container:"), F.trim(F.regexp_replace(F.lower(name), "[^0-9a-z]+", "-"), F.lit("-")))


def surviving(edges: DataFrame, rules: Rules, declared_exempt: bool = True) -> DataFrame:
    """Edges at or over the threshold after the private cut; declared and contract edges pass anyway.

    A declared edge below the threshold is tagged ``suspicious-declared``.
    """
    cut = ev.PRIVATE_CUT * ev.private_items(F.col("evidence")) if rules.down_weight_private else F.lit(0)
    weighed = edges.withColumn("weight", F.greatest(F.lit(0).cast("long"), F.col("weight") - cut))
    low = F.col("weight") < rules.min_weight
    tags = F.when(low & F.col("is_declared_dependency"), F.array(F.lit("suspicious-declared"))).otherwise(F.array().cast("array<string>"))
    exempt = F.col("is_declared_dependency") if declared_exempt else F.lit(False)
    return weighed.withColumn("tags", tags).where(~low | exempt)


def curate(targets: DataFrame, edges: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """Targets and edges after exclusion, grouping, external drop, kinds, private cut and threshold."""
    kept = group(exclude(targets, rules), rules)
    if rules.drop_external:
        kept = kept.where(~F.col("external") | F.exists("tags", lambda t: t.startswith("seam:")))
    ids = kept.select(F.col("id").alias("_id"))
    inside = edges
    for end in ("source", "target"):
        inside = inside.join(ids, F.col(end) == F.col("_id"), "left_semi")
    kinds = inside.withColumn("kind", ev.first_kind(F.col("evidence"), rules.kinds))
    named = kept.withColumn("container_id", F.coalesce(container_id(F.col("group_name")), F.col("id")))
    return named, surviving(kinds, rules)


def lint(targets: DataFrame, rules: Rules) -> DataFrame:
    """Globs that match nothing (dead) or only what earlier rules took (shadowed)."""
    rows = []
    position = 0
    for index, rule in enumerate(rules.groups):
        for pattern in rule.globs:
            rows.append(F.struct(F.lit(position).alias("position"), F.lit(index).alias("rule_index"), F.lit(pattern).alias("pattern"), matches(pattern).alias("hit")))
            position += 1
    hits = targets.select("id", F.array(*rows).alias("rules")).select("id", F.explode("rules").alias("r"))
    first = hits.where("r.hit").groupBy("id").agg(F.min("r.position").alias("first"))
    counted = hits.join(first, "id", "left").groupBy(F.col("r.position").alias("position"), F.col("r.rule_index").alias("rule_index"), F.col("r.pattern").alias("pattern")).agg(
        F.count_if("r.hit").alias("matched"), F.count_if(F.col("r.hit") & (F.col("first") == F.col("r.position"))).alias("fresh")
    )
    found = counted.where("fresh = 0").withColumn("finding", F.when(F.col("matched") == 0, "dead-glob").otherwise("shadowed-glob"))
    return found.select("rule_index", "pattern", "finding", "matched")


def transform_components(components: DataFrame, exclude_globs: list[str], depth: int | None) -> DataFrame:
    """Namespace children with excluded keys gone, keys cut to ``depth`` segments, and duplicates merged."""
    gone = F.lit(False)
    for pattern in exclude_globs:
        gone = gone | glob(F.col("key"), pattern)
    separator = F.when(F.col("key").contains("::"), "::").otherwise(".")
    cut = F.array_join(F.slice(F.split(F.col("key"), r"::|\."), 1, depth), "\u0001") if depth else F.col("key")
    short = F.replace(cut, F.lit("\u0001"), separator)
    return components.where(~gone).withColumn("key", short).groupBy("id", "key").agg(F.count("*").alias("merged"))
