"""Graph and partition text lines: ``depend <source> <target>`` and ``contain <container> <member>``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def quoted(entity: Column) -> Column:
    """Entities with white space stand in double quotes."""
    return F.when(entity.rlike(r"\s"), F.concat(F.lit('"'), entity, F.lit('"'))).otherwise(entity)


def depend_lines(edges: DataFrame, targets: DataFrame, include_external: bool = False) -> DataFrame:
    """Distinct lines of edges between kept targets, loops left out."""
    kept = (targets if include_external else targets.where("NOT external")).select(F.col("id").alias("_id"))
    inside = edges.where("source <> target")
    for end in ("source", "target"):
        inside = inside.join(kept, F.col(end) == F.col("_id"), "left_semi")
    return inside.select(F.concat_ws(" ", F.lit("depend"), quoted(F.col("source")), quoted(F.col("target"))).alias("line")).distinct()


def contain_lines(targets: DataFrame, include_external: bool = False) -> DataFrame:
    """Distinct lines of members; a target without a container is its own."""
    kept = targets if include_external else targets.where("NOT external")
    return kept.select(F.concat_ws(" ", F.lit("contain"), quoted(F.coalesce("container_id", "id")), quoted(F.col("id"))).alias("line")).distinct()


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """``relation, a, b`` of each line; other lines are dropped."""
    token = r'("[^"]*"|\S+)'
    pattern = rf"^\s*(\S+)\s+{token}\s+{token}\s*$"
    cut = [F.regexp_extract(column, pattern, k) for k in (1, 2, 3)]
    rows = lines.select(cut[0].alias("relation"), *(F.regexp_replace(c, '^"|"$', "").alias(n) for c, n in zip(cut[1:], "ab")))
    return rows.where("relation <> ''")
