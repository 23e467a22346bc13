"""Reader of the Parquet tables that a data folder holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of ``sf_dir``, a path of any file system that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
