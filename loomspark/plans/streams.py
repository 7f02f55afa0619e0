"""Queries that read a table as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.sources.tables import table
from loomspark.streaming import windows as S


def stream_event_windows(spark, sf):
    """Events of every day and type, counted by a stream over the files of ``events``."""
    schema = table(spark, sf, "events").schema
    events = S.stream(spark, f"{sf}/events.parquet*", schema)  # a pattern, as the table may be one file or a folder
    counts = S.drain(S.window_counts(events, "ts", "event_type", "value", "1 day"))
    return counts.select(F.date_format("start", "yyyy-MM-dd").alias("day"), F.col("key").alias("event_type"), "n", F.round("total", 4).alias("total"))


QUERIES = {"stream_event_windows": stream_event_windows}

SQL = {
    "stream_event_windows": """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total
FROM events WHERE ts IS NOT NULL GROUP BY 1, 2""",
}
