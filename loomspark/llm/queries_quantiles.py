"""Percentile queries over ``query_log``."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.llm import quantiles as Q
from loomspark.sources.tables import table

QS = [0.5, 0.9, 0.95, 0.99]


def _requests(spark, sf, *more):
    """Each request once, with its day and its mode in one spelling."""
    log = table(spark, sf, "query_log")
    named = {"query": F.lower(F.trim("query")).alias("query")}
    mode = F.lower(F.trim("mode"))
    rows = log.select(
        "id",
        F.col("total_ms").cast("double").alias("total_ms"),
        F.lower(F.trim("tool")).alias("tool"),
        F.when(mode != "", mode).otherwise("none").alias("mode"),
        F.floor(F.col("timestamp") / 86400).cast("long").alias("day"),
        *[named[c] for c in more],
    )
    return Q.one_row_per_id(rows, "id", ["total_ms", "tool", "mode", "day", *more])


def _shown(df):
    """Percentiles in milliseconds with six digits, as engines differ in the last bits of a power."""
    return df.select(*[F.round(c, 6).alias(c) if c.startswith("p") else c for c in df.columns])


def p3_levels(spark, sf):
    """Percentiles per tool and mode, and per tool, mode and query, from the same sketches."""
    fine = Q.sketch(_requests(spark, sf, "query"), "total_ms", ["tool", "mode", "query"])
    both = Q.levels(fine, {"query": ["tool", "mode", "query"], "mode": ["tool", "mode"]})
    return _shown(Q.percentiles(both, ["level", "tool", "mode", "query"], QS))


def p3_percentiles(spark, sf):
    """Percentiles per tool and mode, combined from the sketches of the days."""
    daily = Q.sketch(_requests(spark, sf), "total_ms", ["day", "tool", "mode"])
    return _shown(Q.percentiles(Q.merge(daily, ["tool", "mode"]), ["tool", "mode"], QS))


def p3_daily_sketch(spark, sf):
    """The sketch of each day, tool and mode, as it would be stored."""
    return Q.sketch(_requests(spark, sf), "total_ms", ["day", "tool", "mode"])


def p3_daily_percentiles(spark, sf):
    """Percentiles per day over all tools and modes, from the same daily sketches."""
    daily = Q.sketch(_requests(spark, sf), "total_ms", ["day", "tool", "mode"])
    return _shown(Q.percentiles(Q.merge(daily, ["day"]), ["day"], QS))


QUERIES = {"p3_levels": p3_levels, "p3_percentiles": p3_percentiles, "p3_daily_sketch": p3_daily_sketch, "p3_daily_percentiles": p3_daily_percentiles}

_BASE = (1 + Q.ACCURACY) / (1 - Q.ACCURACY)
_SKETCH = f"""
one AS (
  SELECT DISTINCT ON (id) CAST(total_ms AS DOUBLE) AS v, lower(trim(tool)) AS tool,
    CASE WHEN trim(mode) <> '' THEN lower(trim(mode)) ELSE 'none' END AS mode,
    CAST(floor(timestamp / 86400) AS BIGINT) AS day
  FROM query_log WHERE id IS NOT NULL ORDER BY id, total_ms DESC
),
daily AS (
  SELECT day, tool, mode,
    CASE WHEN isfinite(v) THEN CAST(sign(v) AS INTEGER) END AS sign,
    CASE WHEN NOT isfinite(v) OR v IS NULL THEN NULL WHEN v = 0 THEN 0 ELSE CAST(ceil(ln(abs(v)) / ln({_BASE!r}::DOUBLE)) AS INTEGER) END AS bucket,
    count(*) AS n
  FROM one GROUP BY ALL
)"""


_QUERY_SKETCH = _SKETCH.replace("AS mode,", "AS mode, lower(trim(query)) AS query,").replace("day, tool, mode,", "day, tool, mode, query,")
_LEVELS = """,
fine AS (SELECT tool, mode, query, sign, bucket, sum(n) AS n FROM daily GROUP BY ALL),
both_levels AS (
  SELECT 'query' AS level, * FROM fine
  UNION ALL
  SELECT 'mode', tool, mode, NULL, sign, bucket, sum(n) FROM fine GROUP BY tool, mode, sign, bucket
)"""


def _sql(by: str, sketch: str = _SKETCH, source: str = "daily") -> str:
    qs = ", ".join(
        f"round(max(CASE WHEN sign IS NOT NULL AND upto >= greatest(1, ceil({q}::DOUBLE * total)) AND upto - n < greatest(1, ceil({q}::DOUBLE * total)) THEN middle END), 6) AS p{q * 100:g}"
        for q in QS
    )
    return f"""WITH {sketch},
m AS (SELECT {by}, sign, bucket, CAST(sum(n) AS BIGINT) AS k FROM {source} GROUP BY {by}, sign, bucket),
s AS (
  SELECT {by}, sign, CASE WHEN sign IS NULL THEN k ELSE 0 END AS skipped, CASE WHEN sign IS NULL THEN 0 ELSE k END AS n,
    sum(CASE WHEN sign IS NULL THEN 0 ELSE k END) OVER (PARTITION BY {by} ORDER BY sign NULLS FIRST, sign * bucket NULLS FIRST ROWS UNBOUNDED PRECEDING) AS upto,
    sum(CASE WHEN sign IS NULL THEN 0 ELSE k END) OVER (PARTITION BY {by}) AS total,
    sign * 2.0::DOUBLE * pow({_BASE!r}::DOUBLE, bucket) / ({_BASE!r}::DOUBLE + 1) AS middle
  FROM m
)
SELECT {by}, CAST(sum(n) AS BIGINT) AS n, CAST(sum(skipped) AS BIGINT) AS n_skipped, {qs} FROM s GROUP BY {by}"""


SQL = {
    "p3_levels": _sql("level, tool, mode, query", _QUERY_SKETCH + _LEVELS, "both_levels"),
    "p3_percentiles": _sql("tool, mode"),
    "p3_daily_sketch": f"WITH {_SKETCH} SELECT day, tool, mode, sign, bucket, n FROM daily",
    "p3_daily_percentiles": _sql("day"),
}
