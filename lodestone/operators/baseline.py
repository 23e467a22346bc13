"""Hand-drawn models against code: bindings, their review, and three-way reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

# Fixed value: bands in ascending order.
BANDS = ("low", "medium", "high")


def confirmed(bindings: DataFrame) -> DataFrame:
    return bindings.where("status = 'confirmed' AND extracted_id IS NOT NULL").select("human_id", "extracted_id")


def rekeyed(bindings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bindings by extracted id, a collision to the smallest human id; and those that lost."""
    ranked = confirmed(bindings).withColumn("_r", F.row_number().over(Window.partitionBy("extracted_id").orderBy("human_id")))
    return ranked.where("_r = 1").drop("_r"), ranked.where("_r > 1").drop("_r")


def accept(bindings: DataFrame, least: str) -> DataFrame:
    """Proposed bindings of a band or better become confirmed."""
    good = F.col("confidence").isin(list(BANDS[BANDS.index(least) :]))
    return bindings.withColumn("status", F.when((F.col("status") == "proposed") & good, "confirmed").otherwise(F.col("status")))


def reconcile(elements: DataFrame, targets: DataFrame, bindings: DataFrame) -> DataFrame:
    """``id, status``: drawn elements that are matched, missing in code or unbound, and code that is not drawn."""
    b = confirmed(bindings)
    drawn = elements.select("human_id").join(b, "human_id", "left").join(targets.select(F.col("id").alias("extracted_id"), F.lit(True).alias("_in")), "extracted_id", "left")
    status = F.when(F.col("extracted_id").isNull(), "unbound").when(F.col("_in"), "matched").otherwise("missing-in-code")
    rest = targets.select("id").join(b.select(F.col("extracted_id").alias("id")), "id", "left_anti").select("id", F.lit("not-in-model").alias("status"))
    return drawn.select(F.col("human_id").alias("id"), status.alias("status")).unionByName(rest)


def regrouped(before: DataFrame, after: DataFrame) -> DataFrame:
    """Targets whose container changed, came or went."""
    both = before.select("id", F.col("container_id").alias("was")).join(after.select("id", F.col("container_id").alias("now")), "id", "full_outer")
    return both.where(~F.col("was").eqNullSafe(F.col("now")))


def metric_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """``metric, before, after, delta`` of two one-row tables of numbers."""
    def long(table: DataFrame, name: str) -> DataFrame:
        return table.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias(name)) for c in sorted(table.columns)))).alias("x")).select("x.*")

    return long(before, "before").join(long(after, "after"), "metric").withColumn("delta", F.col("after") - F.col("before"))


def partition_relation(table: DataFrame) -> DataFrame:
    """How the clusters of ``a`` lie in those of ``b`` (a contingency table): same, split, merged or crossing."""
    by_a, by_b = Window.partitionBy("a"), Window.partitionBy("b")
    cells = table.withColumns({"_na": F.count("*").over(by_a), "_nb": F.count("*").over(by_b)})
    kind = F.when((F.col("_na") == 1) & (F.col("_nb") == 1), "same").when(F.col("_na") == 1, "merged").when(F.col("_nb") == 1, "split").otherwise("crossing")
    return cells.groupBy(kind.alias("relation")).agg(F.count("*").alias("cells"), F.sum("n").alias("entities"))


def win_count(scores: DataFrame, row: str, strict: bool = True) -> DataFrame:
    """Systems where one technique beats all others: ``wins, systems``."""
    own = scores.where(F.col("technique") == row).select("system", F.col("value").alias("own"))
    best = scores.where(F.col("technique") != row).groupBy("system").agg(F.max("value").alias("best"))
    beaten = F.col("own") > F.col("best") if strict else F.col("own") >= F.col("best")
    return own.join(best, "system").agg(F.count_if(beaten).alias("wins"), F.count("*").alias("systems"))
