"""Streams over the events table: late data bounded by a watermark, and running state per user.

The batch operators of the model have no streaming counterpart; these are for feeds of the same data.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Event files of a folder as they arrive; times count as UTC."""
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Number and sum of values of each type and window; events later than ``late`` are dropped."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type")
    return by.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def running_touch(events: DataFrame) -> DataFrame:
    """Events and latest time of each user so far, a row per user and micro-batch that has some."""

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, last = state.get if state.exists else (0, "")
        for batch in batches:
            count += len(batch)
            last = max(last, str(batch["ts"].max()))
        state.update((count, last))
        yield pd.DataFrame({"user_id": [key[0]], "n": [count], "last": [last]})

    rows = events.select("user_id", "ts").groupBy("user_id")
    return rows.applyInPandasWithState(update, "user_id long, n long, last string", "n long, last string", "update", GroupStateTimeout.NoTimeout)
