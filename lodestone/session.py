"""Session helpers: the shared folder for intermediate tables, and writing to it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only where that is unset and the session is local, as in tests, a temporary folder is chosen and
    set; on a cluster its executors would not share that, so there the setting is required.
    """
    configured = spark.conf.get(_SETTING, None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {_SETTING} to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, never a recomputation of what stands
    before, and unlike a local checkpoint no single machine holds the only copy.
    """
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lodestone-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application, once none of its results is needed any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
