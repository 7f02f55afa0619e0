"""Mergeable percentiles with a guaranteed relative error.

A value falls into a signed logarithmic bucket of fixed relative width; a sketch
is the table of bucket counts.  Sketches of separate days or partitions are
combined by adding the counts of equal buckets.  A percentile is read from the
running count over the buckets of its group and differs from the exact value of
the same rank by at most ``accuracy`` of that value.

Defined cases
-------------
* null, NaN and infinite values are counted as ``n_skipped`` and take no part.
* zero has a bucket of its own; negative values have mirrored buckets.
* rank of q among n values: ``ceil(q * n)``, at least 1 (the lower of two middles).
* a group with no value gives a row with null percentiles and ``n`` 0.
* null group keys form a group like any other; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ACCURACY = 0.01


def _base(accuracy: float) -> float:
    if not 0 < accuracy < 1:
        raise ValueError("accuracy must lie between 0 and 1")
    return (1 + accuracy) / (1 - accuracy)


def bucket(value: Column, accuracy: float = ACCURACY) -> Column:
    """Struct of sign and logarithmic bucket; null for what has no place."""
    width = math.log(_base(accuracy))
    fine = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    at = F.when(value == 0, F.lit(0)).otherwise(F.ceil(F.log(F.abs(value)) / F.lit(width)).cast("int"))
    return F.when(fine, F.struct(F.signum(value).cast("int").alias("sign"), at.alias("bucket")))


def sketch(df: DataFrame, value: str, by: list[str], accuracy: float = ACCURACY) -> DataFrame:
    """``(*by, sign, bucket, n)``: one row per group and bucket.

    ``sign`` and ``bucket`` are null in the row that counts the skipped values.
    Only combined counts are shuffled: at most one row per task and bucket.
    """
    b = bucket(F.col(value).cast("double"), accuracy)
    return df.select(*by, b.alias("_b")).groupBy(*by, F.col("_b.sign").alias("sign"), F.col("_b.bucket").alias("bucket")).agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Adds the counts of equal buckets, over whatever ``by`` leaves out."""
    return sketches.groupBy(*by, "sign", "bucket").agg(F.sum("n").alias("n"))


def levels(sketches: DataFrame, named: dict[str, list[str]]) -> DataFrame:
    """Sketches of several grouping levels, all added up from the same ``sketches``.

    ``named`` gives the columns of each level, the first being those of
    ``sketches``; every other level is a merge of the one before, and a column
    that it leaves out is null.
    """
    every = next(iter(named.values()))
    kinds = dict(sketches.dtypes)
    out, held = None, sketches
    for name, by in named.items():
        held = held if out is None else merge(held, by)
        blank = [F.lit(None).cast(kinds[c]).alias(c) for c in every if c not in by]
        shown = held.select(F.lit(name).alias("level"), *by, *blank, "sign", "bucket", "n")
        out = shown if out is None else out.unionByName(shown)
    return out


def percentiles(sketches: DataFrame, by: list[str], qs: list[float], accuracy: float = ACCURACY) -> DataFrame:
    """``(*by, n, n_skipped, p<q>...)`` of merged sketches.

    The window holds one group's buckets, whose number the width bounds,
    however many values they count.
    """
    base = _base(accuracy)
    order = F.col("sign") * F.col("bucket")
    running = W.partitionBy(*by).orderBy("sign", order).rowsBetween(W.unboundedPreceding, 0)
    counted = F.when(F.col("sign").isNotNull(), F.col("n")).otherwise(0)
    middle = F.col("sign") * F.lit(2.0) * F.pow(F.lit(base), F.col("bucket").cast("double")) / F.lit(base + 1)
    steps = sketches.select(
        *by,
        "sign",
        F.when(F.col("sign").isNull(), F.col("n")).otherwise(0).alias("skipped"),
        counted.alias("n"),
        F.sum(counted).over(running).alias("upto"),
        F.sum(counted).over(W.partitionBy(*by)).alias("total"),
        middle.alias("middle"),
    )
    picked = []
    for q in qs:
        rank = F.greatest(F.lit(1), F.ceil(F.lit(float(q)) * F.col("total")))
        hit = F.col("sign").isNotNull() & (F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank)
        picked.append(F.max(F.when(hit, F.col("middle"))).alias("p" + f"{q * 100:g}".replace(".", "_")))
    return steps.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("skipped").alias("n_skipped"), *picked)


def one_row_per_id(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each id once; rows of an id are combined before the shuffle.

    Rows without an id are dropped.  Should the rows of an id disagree, the
    greatest value of ``columns``, compared in their order, holds.
    """
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*columns)).alias("r")).select("r.*")
