"""Queries over the store: sync, text functions, call graph, log and health."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import text as X
from loomspark.operators import graph as G
from loomspark.operators import telemetry as M
from loomspark.sources.tables import clean_project, current_files, table

# The tags of notes
NOTE = r"(?i)(?:#|//|/\*)[ \t]*(TODO|FIXME|HACK|NOTE|XXX)\b[ \t:]*([^\n\r]*)"


def _refs(spark, sf):
    return G.call_refs(table(spark, sf, "chunks").withColumn("project", clean_project("project")), table(spark, sf, "symbols"))


def link_centrality(spark, sf):
    """In-degree score of every called name per project."""
    return G.centrality(_refs(spark, sf))


def callers(spark, sf):
    """The first 100 calling chunks of every name."""
    refs = _refs(spark, sf).select("callee", "caller", "caller_id").distinct()
    return G.first_per_key(refs, "callee", [F.col("caller"), F.col("caller_id")], 100)


def definitions(spark, sf):
    """The first eight definitions of every name, by id."""
    rows = table(spark, sf, "symbols").where("name IS NOT NULL AND id IS NOT NULL").groupBy("name", "id").agg(F.max("filepath").alias("filepath"), F.max("line").alias("line"))
    return G.first_per_key(rows, "name", [F.col("id")], 8)


def impact(spark, sf):
    """Names whose code leads to a class within three calls, and how far off they are."""
    edges = _refs(spark, sf).select(F.col("callee").alias("source"), F.col("caller").alias("target"))
    seeds = table(spark, sf, "symbols").where("symbol_type = 'class'").select("name")
    return G.reach(edges, seeds, 3)


def sync_status(spark, sf):
    """What a sync does with each path: the newest scan against the stored state."""
    scan = table(spark, sf, "raw_sources").where("filepath IS NOT NULL")
    newest = F.max(F.struct("last_modified", "sha256"))
    disk = scan.groupBy("filepath").agg(newest.alias("s")).select("filepath", "s.sha256")
    return M.sync_status(disk, current_files(table(spark, sf, "files")))


def text_windows(spark, sf):
    """Windows of 60 lines with an overlap of 10 over every document."""
    docs = table(spark, sf, "documents").select("doc_id", F.explode(X.line_windows(F.col("text"), 60, 10)).alias("w"))
    return docs.select("doc_id", "w.start_line", "w.end_line", F.sha2("w.body", 256).alias("body_hash"))


def text_handles(spark, sf):
    """Hash, handle, token estimate and compacted length of every chunk."""
    rows = table(spark, sf, "chunks")
    c = F.col("content")
    shown = rows.select(
        "id",
        F.sha2(c, 256).alias("hash"),
        X.ref_handle(F.col("filepath"), F.col("start_line"), F.col("end_line"), c).alias("ref"),
        X.token_estimate(c).alias("tokens"),
        F.length(X.compact_blank(c)).alias("compacted"),
    )
    return shown.distinct()  # of hashes and figures, not of texts


def annotation_scan(spark, sf):
    """Notes such as TODO in comments, one row per line of a chunk that holds one."""
    rows = table(spark, sf, "chunks").where(F.col("content").rlike(NOTE)).select("id", "start_line", "content").distinct()
    lines = rows.select("id", "start_line", F.posexplode(F.split("content", "\n")).alias("at", "line")).where(F.col("line").rlike(NOTE))
    found = lines.select(
        "id",
        (F.col("start_line") + F.col("at")).alias("line_no"),
        F.upper(F.regexp_extract("line", NOTE, 1)).alias("tag"),
        F.substring(F.trim(F.regexp_replace(F.regexp_extract("line", NOTE, 2), r"\s*\*/.*$", "")), 1, 500).alias("note"),
    )
    return found.where("note <> ''")


def query_strings(spark, sf):
    """Requests of every normalized query string."""
    rows = M.requests(table(spark, sf, "query_log")).where("query IS NOT NULL")
    return rows.groupBy(X.normalize_query(F.col("query")).alias("query")).agg(F.count("*").alias("n"))


def latency_summary(spark, sf):
    """Latency of every tool, with percentiles of its last 1000 requests."""
    return M.latency_summary(table(spark, sf, "query_log"))


def latency_overall(spark, sf):
    """Latency of all requests, with percentiles of the last 1000."""
    return M.latency_summary(table(spark, sf, "query_log"), overall=True)


def stage_percentiles(spark, sf):
    """Time of every stage over the retained requests."""
    return M.stage_percentiles(table(spark, sf, "query_log"))


def stage_percentiles_all(spark, sf):
    """Time of every stage over all requests."""
    return M.stage_percentiles_all(table(spark, sf, "query_log"))


def cache_rate(spark, sf):
    """Share of cache hits of every tool."""
    return M.cache_rate(table(spark, sf, "query_log"))


def log_retention(spark, sf):
    """The requests that the store retains."""
    return M.retained(table(spark, sf, "query_log")).select("id", "tool", "query")


def error_density(spark, sf):
    """Per project: files, files with a stored diagnostic, and their share in percent."""
    bad = table(spark, sf, "syntax_errors").where("filepath IS NOT NULL").select("filepath").distinct().withColumn("bad", F.lit(1))
    files = current_files(table(spark, sf, "files")).join(bad, "filepath", "left")
    rows = files.groupBy("project").agg(F.count("*").alias("n_files"), F.count("bad").alias("n_bad"))
    return rows.withColumn("percent", F.round(F.col("n_bad") * 100.0 / F.col("n_files"), 4))


def hotspots(spark, sf):
    """The ten files with the most definitions."""
    rows = table(spark, sf, "symbols").select("id", "filepath").distinct().groupBy("filepath").agg(F.count("*").alias("n"))
    return rows.orderBy(F.col("n").desc(), "filepath").limit(10)


def table_counts(spark, sf):
    """Rows of every table of the store."""
    names = ["files", "raw_sources", "chunks", "symbols", "syntax_errors", "query_log", "documents", "embeddings"]
    parts = [table(spark, sf, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in names]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


QUERIES = {
    f.__name__: f
    for f in (
        link_centrality, callers, definitions, impact, sync_status, text_windows, text_handles, annotation_scan,
        query_strings, latency_summary, latency_overall, stage_percentiles, stage_percentiles_all, cache_rate, log_retention, error_density, hotspots, table_counts,
    )
}

_PROJECT = "nullif(lower(trim(project)), '')"
_FILES = f"""cur AS (SELECT filepath, sha256, {_PROJECT} AS project FROM (SELECT *, row_number() OVER
  (PARTITION BY filepath ORDER BY last_modified DESC NULLS LAST, sha256 DESC NULLS LAST, project DESC NULLS LAST) AS k FROM files WHERE filepath IS NOT NULL) WHERE k = 1)"""
_REFS = f"""code AS (SELECT id, max_by(symbol_name, row(symbol_name, {_PROJECT}, content)) AS caller, max_by({_PROJECT}, row(symbol_name, {_PROJECT}, content)) AS project,
  max_by(content, row(symbol_name, {_PROJECT}, content)) AS content FROM chunks WHERE chunk_type = 'code' AND symbol_name IS NOT NULL GROUP BY id),
refs AS (SELECT id AS caller_id, caller, callee, project, count(*) AS n FROM (SELECT *, unnest(regexp_extract_all(content, '{G.CALL}', 1)) AS callee FROM code)
  WHERE callee <> caller AND callee IN (SELECT name FROM symbols WHERE name IS NOT NULL) GROUP BY ALL)"""
_LOG = "log AS (SELECT DISTINCT ON (id) * FROM query_log WHERE id IS NOT NULL)"
_OK = "{0} IS NOT NULL AND NOT isnan({0}) AND {0} > 0"
_NOTE = NOTE.replace("(?i)", "")



def _latency(by: str) -> str:
    places = ", ".join(f"max(v) FILTER (WHERE pos = least(CAST(floor(k * {p} / 100) AS BIGINT), k - 1)) AS p{p}" for p in (50, 95, 99))
    return f"""WITH {_LOG}, u AS (SELECT {by} AS tool, id, timestamp, total_ms AS v FROM log WHERE {_OK.format('total_ms')}),
t AS (SELECT tool, count(*) AS n, min(v) AS least, max(v) AS greatest, round(avg(v), 4) AS mean FROM u GROUP BY tool),
a AS (SELECT *, row_number() OVER (PARTITION BY tool ORDER BY timestamp DESC NULLS LAST, id DESC) AS age FROM u),
b AS (SELECT tool, v, row_number() OVER (PARTITION BY tool ORDER BY v, id) - 1 AS pos, count(*) OVER (PARTITION BY tool) AS k FROM a WHERE age <= 1000),
c AS (SELECT tool, {places} FROM b GROUP BY tool)
SELECT t.*, p50, p95, p99 FROM t JOIN c ON c.tool IS NOT DISTINCT FROM t.tool"""


SQL = {
    "link_centrality": f"""WITH {_REFS}, k AS (SELECT project, callee, CAST(sum(n) AS BIGINT) AS n_refs FROM refs GROUP BY project, callee)
SELECT project, callee, n_refs, round(ln(1 + n_refs) / ln(1 + max(n_refs) OVER (PARTITION BY project)), 6) AS score FROM k""",
    "callers": f"""WITH {_REFS} SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY callee ORDER BY caller, caller_id) AS INTEGER) AS place
FROM (SELECT DISTINCT callee, caller, caller_id FROM refs)) WHERE place <= 100""",
    "definitions": """SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY name ORDER BY id) AS INTEGER) AS place
FROM (SELECT name, id, max(filepath) AS filepath, max(line) AS line FROM symbols WHERE name IS NOT NULL AND id IS NOT NULL GROUP BY name, id)) WHERE place <= 8""",
    "impact": f"""WITH RECURSIVE {_REFS}, e AS (SELECT DISTINCT callee AS source, caller AS target FROM refs),
r(name, distance) AS (SELECT DISTINCT name, 0 FROM symbols WHERE symbol_type = 'class' AND name IS NOT NULL
  UNION SELECT e.target, r.distance + 1 FROM r JOIN e ON e.source = r.name WHERE r.distance < 3)
SELECT name, min(distance) AS distance FROM r GROUP BY name""",
    "sync_status": f"""WITH {_FILES}, d AS (SELECT filepath, sha256 FROM (SELECT *, row_number() OVER (PARTITION BY filepath ORDER BY last_modified DESC NULLS LAST, sha256 DESC NULLS LAST) AS k
  FROM raw_sources WHERE filepath IS NOT NULL) WHERE k = 1)
SELECT coalesce(d.filepath, cur.filepath) AS filepath, CASE WHEN cur.filepath IS NULL THEN 'added' WHEN d.filepath IS NULL THEN 'pruned'
  WHEN d.sha256 IS NOT DISTINCT FROM cur.sha256 THEN 'skipped' ELSE 'updated' END AS status FROM d FULL JOIN cur ON d.filepath = cur.filepath""",
    "text_windows": """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, x, unnest(generate_series(1, greatest(1, len(x) - 10), 50)) AS a FROM l)
SELECT doc_id, CAST(a AS INTEGER) AS start_line, CAST(least(a + 59, len(x)) AS INTEGER) AS end_line, sha256(array_to_string(x[a:a + 59], chr(10))) AS body_hash FROM s""",
    "text_handles": r"""SELECT id, sha256(content) AS hash, 'ref:' || left(sha1(concat_ws(':', filepath, start_line, end_line, content)), 8) AS ref,
  CAST(greatest(1, floor(length(content) / 4)) AS INTEGER) AS tokens,
  CAST(length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content,
    '\r\n|[\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]', chr(10), 'g'), '\n\z', ''), '(?m)[^\S\n]+$', '', 'g'), '\A\n{2,}', chr(10)), '\n{3,}', chr(10) || chr(10), 'g'),
    '\n{2,}\z', chr(10)), '\A\n+\z', '')) AS INTEGER) AS compacted
FROM (SELECT DISTINCT id, filepath, start_line, end_line, content FROM chunks)""",
    "annotation_scan": f"""WITH l AS (SELECT id, start_line, generate_subscripts(x, 1) AS pos, unnest(x) AS line FROM
  (SELECT DISTINCT id, start_line, string_split(content, chr(10)) AS x FROM chunks))
SELECT * FROM (SELECT id, CAST(start_line + pos - 1 AS INTEGER) AS line_no, upper(regexp_extract(line, '{_NOTE}', 1, 'i')) AS tag,
  left(trim(regexp_replace(regexp_extract(line, '{_NOTE}', 2, 'i'), '\\s*\\*/.*$', '')), 500) AS note FROM l WHERE regexp_matches(line, '{_NOTE}', 'i')) WHERE note <> ''""",
    "query_strings": rf"WITH {_LOG} SELECT trim(regexp_replace(lower(query), '\s+', ' ', 'g')) AS query, count(*) AS n FROM log WHERE query IS NOT NULL GROUP BY 1",
    "latency_summary": _latency("tool"),
    "latency_overall": _latency("CAST(NULL AS VARCHAR)"),
    "stage_percentiles": f"""WITH {_LOG}, r AS (SELECT * FROM log ORDER BY id DESC LIMIT 10000),
s AS (SELECT id, unnest(map_keys(stages)) AS stage, unnest(map_values(stages)) AS v FROM r UNION ALL SELECT id, 'total', total_ms FROM r),
b AS (SELECT stage, v, row_number() OVER (PARTITION BY stage ORDER BY v, id) - 1 AS pos, count(*) OVER (PARTITION BY stage) AS k FROM s WHERE {_OK.format('v')})
SELECT stage, count(*) AS n, {', '.join(f"max(v) FILTER (WHERE pos = CAST(round_even((k - 1) * {p} / 100, 0) AS BIGINT)) AS p{p}" for p in (50, 95))} FROM b GROUP BY stage""",
    "stage_percentiles_all": f"""WITH {_LOG}, r AS (SELECT * FROM log),
s AS (SELECT id, unnest(map_keys(stages)) AS stage, unnest(map_values(stages)) AS v FROM r UNION ALL SELECT id, 'total', total_ms FROM r),
b AS (SELECT stage, v, row_number() OVER (PARTITION BY stage ORDER BY v, id) - 1 AS pos, count(*) OVER (PARTITION BY stage) AS k FROM s WHERE {_OK.format('v')})
SELECT stage, count(*) AS n, {', '.join(f"max(v) FILTER (WHERE pos = CAST(round_even((k - 1) * {p} / 100, 0) AS BIGINT)) AS p{p}" for p in (50, 95))} FROM b GROUP BY stage""",
    "cache_rate": f"""WITH {_LOG} SELECT tool, count(*) AS n, count(*) FILTER (WHERE cache_hit) AS hits, round(count(*) FILTER (WHERE cache_hit) * 100.0::DOUBLE / count(*), 4) AS percent FROM log GROUP BY tool""",
    "log_retention": f"WITH {_LOG} SELECT id, tool, query FROM log ORDER BY id DESC LIMIT 10000",
    "error_density": f"""WITH {_FILES} SELECT project, count(*) AS n_files, count(*) FILTER (WHERE bad) AS n_bad, round(count(*) FILTER (WHERE bad) * 100.0::DOUBLE / count(*), 4) AS percent
FROM (SELECT project, filepath IN (SELECT filepath FROM syntax_errors WHERE filepath IS NOT NULL) AS bad FROM cur) GROUP BY project""",
    "hotspots": "SELECT filepath, count(*) AS n FROM (SELECT DISTINCT id, filepath FROM symbols) GROUP BY filepath ORDER BY n DESC, filepath LIMIT 10",
    "table_counts": " UNION ALL ".join(
        f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in ("files", "raw_sources", "chunks", "symbols", "syntax_errors", "query_log", "documents", "embeddings")
    ),
}
