"""Queries that bring the store up to date with a newer scan of the sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions import text as X
from loomspark.operators import merge as M
from loomspark.operators import telemetry as T
from loomspark.plans import store
from loomspark.sources.tables import clean_project, current_files, table

LINES, SHARED = 60, 10


def _version(spark, sf, newest: bool) -> DataFrame:
    """The oldest or the newest scanned text of every path."""
    scan = table(spark, sf, "raw_sources").where("filepath IS NOT NULL AND content IS NOT NULL")
    pick = F.max_by if newest else F.min_by
    keys = scan.groupBy("filepath").agg(pick("sha256", F.struct("last_modified", "sha256")).alias("sha256"))
    texts = scan.join(keys, ["filepath", "sha256"]).select("filepath", F.xxhash64("content").alias("h"), "content")
    return texts.groupBy("filepath").agg(F.max("content").alias("content"))


def _windows(texts: DataFrame) -> DataFrame:
    parts = texts.select("filepath", F.posexplode(X.line_windows(F.col("content"), LINES, SHARED)).alias("ordinal", "w"))
    parent = F.when(F.col("ordinal") > 0, 0)
    return parts.select("filepath", "ordinal", F.sha2("w.body", 256).alias("content_hash"), F.lit("window").alias("name"), parent.alias("parent"))


def merge_chunks(spark, sf):
    """What becomes of the windows of every file when its newest text replaces its oldest one."""
    stored = M.with_ids(_windows(_version(spark, sf, False)), 0)
    return M.merge_chunks(stored, _windows(_version(spark, sf, True)))


def merge_counts(spark, sf):
    """How many windows the merge keeps, inserts and deletes."""
    return merge_chunks(spark, sf).groupBy("action").agg(F.count("*").alias("n"))


def upsert_files(spark, sf):
    """The file states after an upsert of what was scanned last into what is stored."""
    stored = current_files(table(spark, sf, "files")).select("filepath", "sha256", "last_modified")
    scan = table(spark, sf, "raw_sources").where("filepath IS NOT NULL").groupBy("filepath").agg(F.max(F.struct("last_modified", "sha256")).alias("s"))
    return M.upsert(stored, scan.select("filepath", "s.sha256", "s.last_modified"), "filepath")


def cascade_delete(spark, sf):
    """Rows of each table that stay when the files that hold a stored diagnostic are deleted."""
    gone = table(spark, sf, "syntax_errors").select("filepath")
    left = M.cascade({n: table(spark, sf, n) for n in ("chunks", "files", "symbols")}, gone)
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in left.items()])


def sync_counts(spark, sf):
    """How many files a sync adds, updates, prunes and skips."""
    return store.sync_status(spark, sf).groupBy("status").agg(F.count("*").alias("n"))


def error_changes(spark, sf):
    """Diagnostics that are new on a day, and those of the day before that are resolved."""
    day = F.floor(F.col("timestamp") / 86400).cast("long")
    keys = table(spark, sf, "syntax_errors").where("filepath IS NOT NULL AND timestamp IS NOT NULL").select(day.alias("day"), "filepath", "line", "col").distinct()
    key = ["day", "filepath", F.coalesce("line", F.lit(-1)).alias("line"), F.coalesce("col", F.lit(-1)).alias("col")]
    keys = keys.select(*key)
    fresh = keys.join(keys.withColumn("day", F.col("day") + 1), ["day", "filepath", "line", "col"], "left_anti").withColumn("change", F.lit("new"))
    over = keys.withColumn("day", F.col("day") + 1).join(keys, ["day", "filepath", "line", "col"], "left_anti").withColumn("change", F.lit("resolved"))
    return fresh.unionByName(over)


QUERIES = {f.__name__: f for f in (merge_chunks, merge_counts, upsert_files, cascade_delete, sync_counts, error_changes)}

_SCAN = "(SELECT * FROM raw_sources WHERE filepath IS NOT NULL AND content IS NOT NULL)"


def _windows_sql(tag: str, order: str) -> str:
    return f"""{tag}v AS (SELECT filepath, sha256 FROM (SELECT filepath, sha256, row_number() OVER (PARTITION BY filepath ORDER BY last_modified {order}, sha256 {order}) AS k FROM {_SCAN}) WHERE k = 1),
{tag}t AS (SELECT s.filepath, max(s.content) AS content FROM {_SCAN} AS s JOIN {tag}v AS v ON v.filepath = s.filepath AND v.sha256 = s.sha256 GROUP BY s.filepath),
{tag}l AS (SELECT filepath, string_split(content, chr(10)) AS x FROM {tag}t),
{tag}w AS (SELECT filepath, x, unnest(generate_series(1, greatest(1, len(x) - {SHARED}), {LINES - SHARED})) AS a FROM {tag}l),
{tag} AS (SELECT filepath, CAST((a - 1) / {LINES - SHARED} AS INTEGER) AS ordinal, sha256(array_to_string(x[a:a + {LINES - 1}], chr(10))) AS hash FROM {tag}w)"""


_MERGE = f"""{_windows_sql('o', 'ASC')}, {_windows_sql('n', 'DESC')},
old AS (SELECT *, row_number() OVER (ORDER BY left(sha256(filepath), 3), filepath, ordinal) AS id FROM o),
oldk AS (SELECT *, row_number() OVER (PARTITION BY filepath, hash ORDER BY id) AS k FROM old),
newk AS (SELECT *, row_number() OVER (PARTITION BY filepath, hash ORDER BY ordinal) AS k FROM n),
b AS (SELECT coalesce(newk.filepath, oldk.filepath) AS filepath, newk.ordinal, oldk.id FROM newk FULL JOIN oldk ON oldk.filepath = newk.filepath AND oldk.hash = newk.hash AND oldk.k = newk.k),
m AS (
  SELECT filepath, ordinal, id, CASE WHEN ordinal IS NULL THEN 'deleted' ELSE 'kept' END AS action FROM b WHERE id IS NOT NULL
  UNION ALL
  SELECT filepath, ordinal, (SELECT max(id) FROM old) + row_number() OVER (ORDER BY left(sha256(filepath), 3), filepath, ordinal), 'inserted' FROM b WHERE id IS NULL
),
mm AS (SELECT m.filepath, m.ordinal, m.id, p.id AS parent_id, m.action FROM m LEFT JOIN m AS p ON p.filepath = m.filepath AND p.ordinal = 0 AND m.ordinal > 0)"""
_KEYS = "k AS (SELECT DISTINCT CAST(floor(timestamp / 86400) AS BIGINT) AS day, filepath, coalesce(line, -1) AS line, coalesce(col, -1) AS col FROM syntax_errors WHERE filepath IS NOT NULL AND timestamp IS NOT NULL)"

SQL = {
    "merge_chunks": f"WITH {_MERGE} SELECT * FROM mm",
    "merge_counts": f"WITH {_MERGE} SELECT action, count(*) AS n FROM mm GROUP BY action",
    "upsert_files": f"""WITH {store._FILES.replace('sha256, {0}'.format(store._PROJECT), 'sha256, last_modified, ' + store._PROJECT)},
d AS (SELECT filepath, sha256, last_modified FROM (SELECT *, row_number() OVER (PARTITION BY filepath ORDER BY last_modified DESC NULLS LAST, sha256 DESC NULLS LAST) AS k FROM raw_sources WHERE filepath IS NOT NULL) WHERE k = 1)
SELECT * FROM d UNION ALL SELECT filepath, sha256, last_modified FROM cur WHERE filepath NOT IN (SELECT filepath FROM d)""",
    "cascade_delete": " UNION ALL ".join(
        f"SELECT '{n}' AS name, count(*) AS n FROM {n} WHERE filepath IS NULL OR filepath NOT IN (SELECT filepath FROM syntax_errors WHERE filepath IS NOT NULL)" for n in ("chunks", "files", "symbols")
    ),
    "sync_counts": f"SELECT status, count(*) AS n FROM ({store.SQL['sync_status']}) GROUP BY status",
    "error_changes": f"""WITH {_KEYS}
SELECT *, 'new' AS change FROM k WHERE NOT EXISTS (SELECT 1 FROM k AS p WHERE p.day = k.day - 1 AND p.filepath = k.filepath AND p.line = k.line AND p.col = k.col)
UNION ALL
SELECT day + 1 AS day, filepath, line, col, 'resolved' FROM k WHERE NOT EXISTS (SELECT 1 FROM k AS p WHERE p.day = k.day + 1 AND p.filepath = k.filepath AND p.line = k.line AND p.col = k.col)""",
}
