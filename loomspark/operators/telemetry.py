"""Statistics of the query log and of the store.

Defined cases: a repeated id counts once; null, NaN and non-positive times are
no samples; a null tool is a group of its own; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RECENT = 1000
RETAINED = 10_000


def requests(log: DataFrame) -> DataFrame:
    """One row per id; the rows of an id agree."""
    return log.where("id IS NOT NULL").dropDuplicates(["id"])


def _valid(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (c > 0)


def _at(rank: Column, percent: tuple[int, ...], index) -> list[Column]:
    """The value at a position of the sorted group, one column per percent."""
    return [F.max(F.when(rank == index(p), F.col("value"))).alias(f"p{p}") for p in percent]


def latency_summary(log: DataFrame, recent: int = RECENT, overall: bool = False) -> DataFrame:
    """Per tool, or overall: number, least, greatest and mean of all requests, p50, p95, p99 of the last ``recent``.

    The percentile is the value at position ``floor(n * p)``, at most the last.
    The bounded window is the feature: Spark cuts each tool to ``recent`` rows
    in every partition before it shuffles.  Overall has a null tool.
    """
    rows = requests(log).where(_valid(F.col("total_ms"))).select("tool", "id", "timestamp", F.col("total_ms").alias("value"))
    newest = [F.col("timestamp").desc(), F.col("id").desc()]
    if overall:
        rows = rows.withColumn("tool", F.lit(None).cast("string"))
        last = rows.orderBy(*newest).limit(recent)
    else:
        last = rows.withColumn("age", F.row_number().over(Window.partitionBy("tool").orderBy(*newest))).where(F.col("age") <= recent)
    every = rows.groupBy("tool").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("greatest"), F.round(F.avg("value"), 4).alias("mean"))
    last = last.withColumn("at", F.row_number().over(Window.partitionBy("tool").orderBy("value", "id")) - 1)
    last = last.withColumn("k", F.count("*").over(Window.partitionBy("tool")))
    floor = lambda p: F.least((F.col("k") * p / 100).cast("int"), F.col("k") - 1)
    found = last.groupBy(F.col("tool").alias("by")).agg(*_at(F.col("at"), (50, 95, 99), floor))
    return every.join(found, F.col("tool").eqNullSafe(F.col("by"))).drop("by")


def retained(log: DataFrame, keep: int = RETAINED) -> DataFrame:
    """The ``keep`` requests of greatest id, which is what the store retains."""
    return requests(log).orderBy(F.col("id").desc()).limit(keep)


def stage_percentiles(log: DataFrame, keep: int = RETAINED) -> DataFrame:
    """Per stage, and for ``total``: number, p50 and p95 over the retained requests.

    The percentile is the value at position ``p / 100 * (n - 1)``, rounded half
    to even.  A stage has at most ``keep`` rows.
    """
    rows = retained(log, keep)
    stages = rows.where("stages IS NOT NULL").select("id", F.explode("stages").alias("stage", "value"))
    total = rows.select("id", F.lit("total").alias("stage"), F.col("total_ms").alias("value"))
    rows = stages.unionByName(total).where(_valid(F.col("value")))
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("stage").orderBy("value", "id")) - 1)
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("stage")))
    even = lambda p: F.bround((F.col("n") - 1) * p / 100).cast("int")
    return rows.groupBy("stage").agg(F.count("*").alias("n"), *_at(F.col("at"), (50, 95), even))


def stage_percentiles_all(log: DataFrame) -> DataFrame:
    """:func:`stage_percentiles` over every request.

    Values are counted by stage and value, and ranked only in the logarithmic
    buckets, a fiftieth of a power of e wide, that hold a wanted position.
    """
    rows = requests(log)
    stages = rows.where("stages IS NOT NULL").select(F.explode("stages").alias("stage", "value"))
    total = rows.select(F.lit("total").alias("stage"), F.col("total_ms").alias("value"))
    values = stages.unionByName(total).where(_valid(F.col("value"))).groupBy("stage", "value").agg(F.count("*").alias("k"))
    values = values.withColumn("bucket", F.floor(F.log("value") * 50))
    sizes = values.groupBy("stage", "bucket").agg(F.sum("k").alias("size"))
    before = F.sum("size").over(Window.partitionBy("stage").orderBy("bucket")) - F.col("size")
    sizes = sizes.select("stage", "bucket", "size", before.alias("before"), F.sum("size").over(Window.partitionBy("stage")).alias("n"))
    at = {p: F.bround((F.col("n") - 1) * p / 100).cast("long") for p in (50, 95)}
    held = lambda p, low, size: (at[p] >= low) & (at[p] < low + size)
    wanted = sizes.where(held(50, F.col("before"), F.col("size")) | held(95, F.col("before"), F.col("size"))).drop("size")
    upto = F.sum("k").over(Window.partitionBy("stage", "bucket").orderBy("value"))
    rows = values.join(F.broadcast(wanted), ["stage", "bucket"]).withColumn("low", F.col("before") + upto - F.col("k"))
    found = [F.max(F.when(held(p, F.col("low"), F.col("k")), F.col("value"))).alias(f"p{p}") for p in at]
    return rows.groupBy("stage").agg(F.max("n").alias("n"), *found)


def cache_rate(log: DataFrame) -> DataFrame:
    """Per tool: requests, hits and the share of hits in percent."""
    hit = F.coalesce(F.col("cache_hit"), F.lit(False)).cast("long")
    rows = requests(log).groupBy("tool").agg(F.count("*").alias("n"), F.sum(hit).alias("hits"))
    return rows.withColumn("percent", F.round(F.col("hits") * 100.0 / F.col("n"), 4))


def sync_status(disk: DataFrame, stored: DataFrame) -> DataFrame:
    """``(filepath, status)``: added, updated, pruned or skipped.

    Both sides hold one row per ``filepath`` with its ``sha256``; a null sha256
    equals a null only.
    """
    a, b = disk.select("filepath", F.struct("sha256").alias("new")), stored.select("filepath", F.struct("sha256").alias("old"))
    status = (
        F.when(F.col("old").isNull(), "added")
        .when(F.col("new").isNull(), "pruned")
        .when(F.col("new.sha256").eqNullSafe(F.col("old.sha256")), "skipped")
        .otherwise("updated")
    )
    return a.join(b, "filepath", "full_outer").select("filepath", status.alias("status"))
