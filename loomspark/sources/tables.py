"""Readers of the Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name`` of ``folder``; columns and filters reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def clean_project(c):
    """A project name without case and outer spaces; null where nothing is left."""
    c = F.lower(F.trim(F.col(c) if isinstance(c, str) else c))
    return F.when(c != "", c)


def current_files(files: DataFrame) -> DataFrame:
    """The current row of each path: the one with the greatest ``last_modified``.

    Ties, which hold for repeated rows, fall to the greatest sha256.  Rows
    without a path are dropped; a null ``last_modified`` loses to any other.
    The aggregate combines before it shuffles, so a path with very many old
    states is no hot key.
    """
    best = F.max_by(F.struct("sha256", "project", "chunk_count"), F.struct("last_modified", "sha256", "project"))
    return (
        files.where("filepath IS NOT NULL")
        .groupBy("filepath")
        .agg(best.alias("b"), F.max("last_modified").alias("last_modified"))
        .select("filepath", "last_modified", "b.sha256", "b.chunk_count", clean_project(F.col("b.project")).alias("project"))
    )
