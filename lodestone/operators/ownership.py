"""Ownership of paths, ancestor chains and bindings between two sets of names."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf

from lodestone.session import materialise


def longest_prefix(files: DataFrame, owners: DataFrame, path: str = "path", owner: str = "owner") -> DataFrame:
    """Each file with the deepest owner that is its path or a directory above it; others are dropped.

    Paths are exploded into their ancestors, so the prefix test is an equi-join and not a range scan.
    Each path is looked up once, however many rows have it, and every row stays.
    """
    cut = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(cut)), lambda k: F.array_join(F.slice(cut, 1, k), "/"))
    paths = files.select(path).distinct()
    joined = paths.withColumn(owner, F.explode(above)).join(owners.select(owner).distinct(), owner)
    found = joined.groupBy(path).agg(F.max_by(owner, F.length(owner)).alias(owner))
    return files.join(found, path).select(*files.columns, owner)


def ancestor_chains(seeds: DataFrame, links: DataFrame, top=None, rounds: int = 100_000) -> DataFrame:
    """``id, depth, chain``: ancestors of each seed by ``child -> parent``, outermost first.

    A chain ends at ``top``, or, with none given, at a node without a parent. Seeds whose chain comes
    to no such end have no row: those without a parent, and with ``top`` those that don't reach it.
    Raises on chains that run in a circle.
    """
    start = F.array("id").alias("seen")
    out = seeds.select("id", F.col("id").alias("node"), F.lit("").alias("chain"), F.lit(0).alias("depth"), start)
    done = None
    for _ in range(rounds):
        chain = F.when(F.col("chain") == "", F.col("parent").cast("string")).otherwise(F.concat(F.col("parent").cast("string"), F.lit("/"), "chain"))
        known = links.where("child IS NOT NULL AND parent IS NOT NULL")
        step = out.join(known.hint("merge"), F.col("node") == F.col("child")).select("id", F.col("parent").alias("node"), chain.alias("chain"), (F.col("depth") + 1).alias("depth"), F.array_append("seen", F.col("parent")).alias("seen"), F.array_contains("seen", F.col("parent")).alias("again"))
        step = materialise(step, "chains")
        if top is None:
            ended = step.join(known.select(F.col("child").alias("node")).distinct().hint("merge"), "node", "left_anti")
            out = step.join(known.select(F.col("child").alias("node")).distinct().hint("merge"), "node", "left_semi")
        else:
            ended, out = step.where(F.col("node") == top), step.where(F.col("node") != top)
        done = ended if done is None else done.unionByName(ended)
        if out.isEmpty():
            break
        if (round_ := out.where("again").first()) is not None:
            raise ValueError(f"the ancestors of {round_['id']} run in a circle at {round_['node']}")
    return done.select("id", "depth", "chain")


def best_bindings(humans: DataFrame, targets: DataFrame) -> DataFrame:
    """Best target of each human name: equal slugs score 1, ties go to the smallest target."""
    return humans.join(targets, "slug").groupBy("human").agg(F.min("target").alias("target")).withColumn("score", F.lit(1.0))


def token_bindings(humans: DataFrame, targets: DataFrame, floor: float = 0.4, weight: float = 0.85) -> DataFrame:
    """Best target of each human name by weighted Jaccard of token arrays, among those that share a token.

    Pairs come from an equi-join on tokens; names without a common token are left to ``propose_bindings``.
    """
    h = humans.select("human", F.size("tokens").alias("nh"), F.explode("tokens").alias("token"))
    t = targets.select("target", F.size("tokens").alias("nt"), F.explode("tokens").alias("token"))
    shared = h.join(t, "token").groupBy("human", "target", "nh", "nt").agg(F.count("*").alias("n"))
    scored = shared.withColumn("score", F.round(weight * F.col("n") / (F.col("nh") + F.col("nt") - F.col("n")), 4)).where(F.col("score") >= floor)
    order = Window.partitionBy("human").orderBy(F.desc("score"), "target")
    return scored.withColumn("r", F.row_number().over(order)).where("r = 1").select("human", "target", "score")


def propose_bindings(humans: DataFrame, targets: DataFrame, floor: float = 0.4, path_weight: float = 0.85, name_weight: float = 0.7) -> DataFrame:
    """``human, target, score``: the best target of each human by the greatest of three signals.

    ``slugs`` and ``tokens`` are arrays on both sides. Equal slugs score 1, tokens their weighted
    Jaccard, slugs the weighted ratio of their matching blocks. Ties go to the smallest target; a
    human without a target at the floor has a null one and score 0. Pairs for the ratio are all
    distinct slugs whose lengths can reach the floor, an equi-join on the length; then their counts
    of letters bound the ratio. Nothing is left out, so slugs of like lengths make quadratic pairs.
    """
    least = max(1e-9, (floor - 0.0005) / name_weight - 1e-6)

    @pandas_udf("double")
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(left, right):
            match = difflib.SequenceMatcher(None, a, b)
            out.append(match.ratio() if match.quick_ratio() >= least else 0.0)
        return pd.Series(out, dtype=float)

    def each(rows: DataFrame, key: str, column: str, name: str) -> DataFrame:
        return rows.select(key, F.explode(F.array_distinct(column)).alias(name)).where(F.col(name) != "")

    h, t = each(humans, "human", "slugs", "a"), each(targets, "target", "slugs", "b")
    equal = h.join(t, F.col("a") == F.col("b")).select("human", "target", F.lit(1.0).alias("score"))
    ht, tt = each(humans, "human", "tokens", "token"), each(targets, "target", "tokens", "token")
    n_h, n_t = ht.groupBy("human").agg(F.count("*").alias("nh")), tt.groupBy("target").agg(F.count("*").alias("nt"))
    shared = ht.join(tt, "token").groupBy("human", "target").agg(F.count("*").alias("n")).join(n_h, "human").join(n_t, "target")
    overlap = shared.select("human", "target", F.round(path_weight * F.col("n") / (F.col("nh") + F.col("nt") - F.col("n")), 6).alias("score"))
    length, reach = F.length("a"), (2 - least) / least
    spans = F.sequence(F.floor(length / reach).cast("int"), F.ceil(length * reach).cast("int")) if least > 0.05 else None
    left, right = h.select("a").distinct(), t.select("b").distinct()
    pairs = left.crossJoin(right) if spans is None else left.withColumn("k", F.explode(spans)).join(right.withColumn("k", F.length("b")), "k").drop("k")
    alike = pairs.withColumn("score", F.round(name_weight * ratio("a", "b"), 6)).where(F.col("score") > 0)
    named = h.join(alike, "a").join(t, "b").select("human", "target", "score")
    scored = equal.union(overlap).union(named).groupBy("human", "target").agg(F.round(F.max("score"), 3).alias("score")).where(F.col("score") >= floor)
    order = Window.partitionBy("human").orderBy(F.desc("score"), "target")
    best = scored.withColumn("r", F.row_number().over(order)).where("r = 1").select("human", "target", "score")
    return humans.select("human").distinct().join(best, "human", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
