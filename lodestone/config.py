"""Rule files, and a cache of fragments by the hash of what they were made from."""

from __future__ import annotations

import hashlib
import json

import yaml
from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.operators.curate import Group, Rules


def mapping_rules(text: str | None) -> Rules:
    """Rules of a YAML text; an absent one gives the defaults."""
    data = yaml.safe_load(text or "") or {}
    defaults = data.get("defaults") or {}
    listed = lambda v: [v] if isinstance(v, str) else list(v or [])
    excluded = (data.get("exclude") or {}).get("targets") or []
    return Rules(
        exclude=[e["glob"] for e in excluded if "glob" in e],
        exclude_ids=[e["id"] for e in excluded if "id" in e],
        groups=[Group(g["container"], listed(g.get("members")), listed(g.get("members_glob")), listed(g.get("members_tag"))) for g in data.get("group") or []],
        kinds=[(k["when_evidence_contains"], k["kind"]) for k in data.get("relationship_kinds") or []],
        min_weight=int(defaults.get("min_relationship_weight", 3)),
        drop_external=bool(defaults.get("drop_external", True)),
        down_weight_private=bool(defaults.get("down_weight_private", True)),
    )


def layering_rules(spark: SparkSession, text: str | None) -> DataFrame:
    """``rule, from, to`` of the forbidden directions of a YAML text."""
    forbidden = (yaml.safe_load(text or "") or {}).get("forbidden") or []
    return spark.createDataFrame([(f"{r['from']} -> {r['to']}", r["from"], r["to"]) for r in forbidden], "rule string, from string, to string")


def input_key(spark: SparkSession, root: str, pattern: str, version: str) -> str:
    """Hash of the paths and contents of a source tree: files are hashed where they lie, the digests in order after."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    place = root.rstrip("/").split(":")[-1]
    line = F.concat(F.substring_index("path", place, -1), F.lit("\u0000"), F.sha2("content", 256))
    # Digests meet in 4096 blocks by the hash of their paths; the driver sees one hash of each.
    rows = files.select(line.alias("line")).withColumn("block", F.substring(F.md5(F.split_part("line", F.lit("\u0000"), F.lit(1))), 1, 3))
    blocks = rows.groupBy("block").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("h")).orderBy("block").collect()
    total = hashlib.sha256(json.dumps([version, pattern]).encode())
    for row in blocks:
        total.update(f"{row['block']} {row['h']}\n".encode())
    return total.hexdigest()


def cached(spark: SparkSession, folder: str, key: str, build) -> DataFrame:
    """A table by its key: read where it was written whole before, else built and written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{key}/_SUCCESS")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        build().write.mode("overwrite").parquet(f"{folder}/{key}")
    return spark.read.parquet(f"{folder}/{key}")
