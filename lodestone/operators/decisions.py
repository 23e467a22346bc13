"""Decision records: constraints in prose, their check, and the inbox of mined candidates."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, Window, functions as F

from lodestone.functions.texts import canonical_json

# Fixed value: the wording of a structural constraint.
CONSTRAINT = r"(?i)^(.*?)\s+(?:must not|must never|should not|shall not|may not|cannot)\s+(?:directly\s+)?(?:depend on|depend upon|reference|call|use|access|import)\s+(.+?)[.;!]?$"


#: Marks of emphasis, which sentences lose.
MARKS = r"[*_`#>]"


def constraints(records: DataFrame) -> DataFrame:
    """``id, from, to, because, source`` of each sentence that states one; titles before bodies, a pair once."""
    parts = records.select("id", F.posexplode(F.array(F.struct(F.lit("title").alias("source"), F.col("title").alias("text")), F.struct(F.lit("body").alias("source"), F.col("body").alias("text")))).alias("part", "x"))
    plain = F.regexp_replace(F.coalesce("x.text", F.lit("")), MARKS, "")
    sentences = parts.select("id", "part", "x.source", F.posexplode(F.split(plain, r"(?<=[.;!?])\s+|\n+")).alias("at", "sentence")).withColumn("sentence", F.trim("sentence"))
    side = lambda k: F.trim(F.regexp_replace(F.regexp_extract("sentence", CONSTRAINT, k), r"^[ ./-]+|[ ./-]+$", ""))
    found = sentences.withColumns({"from": side(1), "to": side(2)}).where("`from` <> '' AND `to` <> ''")
    order = Window.partitionBy("id", F.lower("from"), F.lower("to")).orderBy("part", "at")
    return found.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("id", "from", "to", F.col("sentence").alias("because"), "source")


def title_links(records: DataFrame, targets: DataFrame, least: int = 4) -> DataFrame:
    """``target, record``: titles that hold a target's name as a run of words; one word alone needs ``least`` letters.

    Titles are exploded into their runs of words, so the names meet them in an equi-join.
    """
    words = lambda c: F.filter(F.split(F.lower(c), "[^0-9a-z]+"), lambda w: w != "")
    title = records.select("id", words(F.col("title")).alias("w")).where(F.size("w") > 0)
    runs = title.select(F.col("id").alias("record"), F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.size("w")), lambda a: F.transform(F.sequence(F.lit(1), F.size("w") - a + 1), lambda n: F.array_join(F.slice("w", a, n), " "))))).alias("run")).distinct()
    names = targets.select(F.col("id").alias("target"), words(F.col("name")).alias("w")).where((F.size("w") > 1) | (F.length(F.element_at("w", 1)) >= least))
    return names.withColumn("run", F.array_join("w", " ")).join(runs, "run").select("target", "record").distinct()


def evidence_hash(rows: list[dict]) -> str:
    """First 16 digits of the hash of the evidence in canonical order."""
    return hashlib.sha256(canonical_json(sorted(rows, key=canonical_json)).encode()).hexdigest()[:16]


def inbox(detected: DataFrame, mined: DataFrame, promoted: DataFrame, dismissed: DataFrame, most: int) -> DataFrame:
    """Open candidates: mined ones unless detected already, promoted ones gone, dismissed ones gone while their evidence is the same."""
    fresh = mined.join(detected.select("kind", "elements"), ["kind", "elements"], "left_anti")
    every = detected.unionByName(fresh).join(promoted.select("slug"), "slug", "left_anti").join(dismissed.select("slug", "evidence_hash"), ["slug", "evidence_hash"], "left_anti")
    return every.orderBy(F.desc("salience"), "slug").limit(most)


def fuse(candidates: DataFrame, slugs: list[str]) -> DataFrame:
    """One candidate of several: elements and evidence united, weights summed, the category kept if they agree."""
    own = candidates.where(F.col("slug").isin(slugs))
    return own.agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("elements")))).alias("elements"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"),
        F.sum("weight").alias("weight"), F.when(F.count_distinct("category") == 1, F.min("category")).alias("category"),
    )


def first_violation(snapshots: DataFrame, source: str, target: str) -> DataFrame:
    """The oldest snapshot (``commit, ordinal, source, target``) with a forbidden edge."""
    return snapshots.where((F.col("source") == source) & (F.col("target") == target)).agg(F.min_by("commit", "ordinal").alias("commit"))


def mentions(text: str, names: list[str], side: str) -> str | None:
    """Longest ending (``from``) or beginning (``to``) of a phrase that is a known name, without case."""
    words, known = re.findall(r"\S+", text), {n.lower(): n for n in reversed(names)}
    cuts = [words[k:] for k in range(len(words))] if side == "from" else [words[: len(words) - k] for k in range(len(words))]
    return next((known[" ".join(c).lower()] for c in cuts if " ".join(c).lower() in known), None)
