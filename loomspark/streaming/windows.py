"""Windowed aggregates over a stream of files.

The stream reads the Parquet files of a folder as they come.  Counts per window
and key are kept as state, so that one row per open window and key is held, and
each trigger writes the whole result under its own batch number: a trigger that
runs again after a failure overwrites what it wrote.  With a watermark, rows
later than ``late`` are dropped and closed windows leave the state.

Defined cases: null times are dropped; a null key is a key; a stream without
files gives no rows.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.session import scratch_dir


def stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """A stream over the Parquet files that match ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def window_counts(events: DataFrame, time_col: str, key_col: str, value_col: str, width: str, late: str | None = None) -> DataFrame:
    """``(start, key, n, total)`` per tumbling window of ``width`` and key; works on streams and tables."""
    events = events.where(F.col(time_col).isNotNull())
    if late:
        events = events.withWatermark(time_col, late)
    grouped = events.groupBy(F.window(time_col, width).alias("w"), F.col(key_col).alias("key"))
    counts = grouped.agg(F.count("*").alias("n"), F.sum(F.col(value_col)).alias("total"))
    return counts.select(F.col("w.start").alias("start"), "key", "n", "total")


def drain(counts: DataFrame, label: str = "stream") -> DataFrame:
    """Runs the stream over all files there are, and gives the result of its last trigger."""
    spark = counts.sparkSession
    base = scratch_dir(spark, label)
    last: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(base, f"batch-{number}"))
        last[:] = [number]

    query = (
        counts.writeStream.outputMode("complete")
        .option("checkpointLocation", os.path.join(base, "state"))
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    if not last:
        return spark.createDataFrame([], counts.schema)
    return spark.read.schema(counts.schema).parquet(os.path.join(base, f"batch-{last[0]}"))
