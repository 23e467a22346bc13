"""Fragments of facts, one JSON document per extractor, as tables; and facts as they are stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from lodestone.operators.merge import fragment_priority

EVIDENCE = "array<struct<type:string,detail:string,count:bigint,visibility:string>>"
CHILD = "struct<id:string,name:string,level:string,source:string,key:string,tags:array<string>,code:array<struct<id:string,name:string,level:string,tags:array<string>>>>"
TARGET = f"struct<id:string,name:string,type:string,language:string,path:string,external:boolean,tags:array<string>,namespaces:array<string>,depends_on:array<string>,responsibilities:array<string>,com_provides:array<string>,package_refs:array<string>,components:array<{CHILD}>>"
NODE = "struct<id:string,name:string,kind:string,subkind:string,technology:string,env:string,ports:array<string>,tags:array<string>,replicas:int,external:boolean>"
SCHEMA = (
    "schema_version string, provenance struct<extractors:array<struct<name:string,version:string>>,coverage:map<string,map<string,string>>>, "
    f"targets array<{TARGET}>, relationships array<struct<id:string,source:string,target:string,kind:string,tags:array<string>,evidence:{EVIDENCE}>>, "
    f"deployment struct<nodes:array<{NODE}>,edges:array<struct<source:string,target:string,kind:string,env:string,evidence:{EVIDENCE}>>>"
)


def read_fragments(spark: SparkSession, path: str) -> DataFrame:
    """A row per document, with its file name and the highest priority of its extractors.

    A document that is no JSON gives a row of nulls, which the tables below drop.
    """
    rows = spark.read.schema(StructType.fromDDL(SCHEMA)).option("multiLine", "true").json(path)
    names = F.transform("provenance.extractors", lambda e: e["name"])
    return rows.withColumns({"fragment": F.element_at(F.split(F.input_file_name(), "/"), -1), "priority": F.coalesce(fragment_priority(names), F.lit(10))})


def targets(fragments: DataFrame) -> DataFrame:
    return fragments.select("fragment", "priority", F.explode("targets").alias("t")).select("fragment", "priority", "t.*").where("id IS NOT NULL")


def items(fragments: DataFrame) -> DataFrame:
    """Evidence items of all edges; an edge without evidence gives one of unknown type."""
    edges = fragments.select("fragment", F.explode("relationships").alias("r"))
    return edges.select("fragment", "r.source", "r.target", "r.kind", F.explode_outer("r.evidence").alias("e")).select("fragment", "source", "target", "kind", "e.*").where("source IS NOT NULL AND target IS NOT NULL")


def coverage(fragments: DataFrame) -> DataFrame:
    by = fragments.select("fragment", F.explode("provenance.coverage").alias("id", "m"))
    return by.select("fragment", "id", F.explode("m").alias("layer", "value"))


def deployment(fragments: DataFrame) -> tuple[DataFrame, DataFrame]:
    nodes = fragments.select("fragment", F.explode("deployment.nodes").alias("n")).select("fragment", "n.*")
    edges = fragments.select("fragment", F.explode("deployment.edges").alias("e")).select("fragment", "e.*")
    return nodes, edges
