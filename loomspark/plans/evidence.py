"""Queries that gather evidence for questions and report on the store."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomspark.functions import text as X
from loomspark.operators import evidence as V
from loomspark.operators import graph as G
from loomspark.operators import search as S
from loomspark.operators import telemetry as M
from loomspark.plans import retrieval, search, store
from loomspark.session import cut
from loomspark.sources.tables import clean_project, current_files, table

BUDGET = 2000


def _refs(spark, sf):
    refs = store._refs(spark, sf).select("caller_id", "callee")
    paths = table(spark, sf, "chunks").groupBy(F.col("id").alias("caller_id")).agg(F.max("filepath").alias("filepath"))
    return refs.join(paths, "caller_id")


def resolved_calls(spark, sf):
    """The definitions that every call leads to, by the first tier that has any."""
    return V.resolved(_refs(spark, sf), table(spark, sf, "symbols"), V.imports(table(spark, sf, "chunks")))


def test_callers(spark, sf):
    """The first ten chunks of test files that call a name."""
    rows = _refs(spark, sf).where(F.col("filepath").rlike(V.TEST_PATH)).select("callee", "filepath", "caller_id").distinct()
    return G.first_per_key(rows, "callee", [F.col("filepath"), F.col("caller_id")], 10)


def evidence_pack(spark, sf):
    """What of the best chunks of each question goes into a budget of tokens, whole, as a stub or not at all."""
    hits = cut(search.search_chunks(spark, sf).select("query_id", "id", "rank"), "evidence-hits")
    rows = table(spark, sf, "chunks").join(S.small(hits.select("id").distinct()), "id", "left_semi").groupBy("id").agg(F.max(F.coalesce("content", F.lit(""))).alias("content"))
    sizes = rows.select("id", X.token_estimate(F.col("content")).alias("body_tokens"), X.token_estimate(V.stub(F.col("content"))).alias("stub_tokens"))
    return V.packed(hits.join(sizes, "id"), BUDGET)


def evidence_items(spark, sf):
    """The five best chunks of each question with their class headers, callees and callers."""
    chunks = table(spark, sf, "chunks")
    seeds = cut(search.search_chunks(spark, sf).where("rank <= 5").select("query_id", "id", "score"), "evidence-seeds")
    links = resolved_calls(spark, sf).join(V.located(table(spark, sf, "symbols"), chunks).withColumnRenamed("id", "callee_id"), "definition_id").where("caller_id <> callee_id")
    place = F.dense_rank().over(Window.partitionBy("caller_id").orderBy("callee"))
    return V.expanded(seeds, chunks, links.select("caller_id", "callee_id", place.alias("place")))


# What begins a definition, by language
DEFINES = {
    "py": r"^\s*(?:async\s+)?(def|class)\s+([A-Za-z_]\w*)", "go": r"^\s*(func|type)\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)",
    "js": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(function|class)\s*\*?\s*([A-Za-z_$][\w$]*)", "rs": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*(fn|struct|enum|trait)\s+([A-Za-z_]\w*)",
    "java": r"^\s*(?:(?:public|private|protected|static|final|abstract|sealed)\s+)*(class|interface|enum|record)\s+([A-Za-z_]\w*)",
}
ENDINGS = {"py": ["py", "pyi"], "go": ["go"], "js": ["js", "jsx", "mjs", "ts"], "rs": ["rs"], "java": ["java"]}
CONTAINERS = ["class", "type", "struct", "enum", "trait", "interface", "record"]


def extracted_symbols(spark, sf):
    """Definitions in the lines of every scanned text, with kind and signature of at most 120 signs."""
    rows = table(spark, sf, "raw_sources").where("filepath IS NOT NULL AND content IS NOT NULL")
    ending = F.lower(F.regexp_extract("filepath", r"\.(\w+)$", 1))
    lines = rows.select("filepath", "sha256", ending.alias("e"), F.posexplode(F.split("content", "\n")).alias("at", "line"))
    pick = lambda g: F.coalesce(*[F.when(F.col("e").isin(ENDINGS[k]), F.regexp_extract("line", p, g)) for k, p in DEFINES.items()])
    found = lines.withColumn("name", pick(2)).where("name <> ''")
    kind = F.when(pick(1).isin(CONTAINERS), "class").otherwise("def")
    return found.select("filepath", "sha256", (F.col("at") + 1).alias("line"), "name", kind.alias("symbol_type"), F.substring(F.trim(F.regexp_replace("line", r"\s+", " ")), 1, 120).alias("signature")).distinct()


def token_savings(spark, sf):
    """Tokens of all bodies and of their stubs, what stubs save, and its price at 3 per million."""
    rows = table(spark, sf, "chunks").where("id IS NOT NULL AND content IS NOT NULL").select("id", X.token_estimate(F.col("content")).alias("raw"), X.token_estimate(V.stub(F.col("content"))).alias("stub"))
    one = rows.groupBy("id").agg(F.max("raw").alias("raw"), F.max("stub").alias("stub"))
    sums = one.agg(F.sum("raw").alias("raw_tokens"), F.sum("stub").alias("stub_tokens"))
    saved = F.greatest(F.lit(0), F.col("raw_tokens") - F.col("stub_tokens"))
    return sums.select(
        "raw_tokens", "stub_tokens", saved.alias("saved"), F.round(saved * 100.0 / F.col("raw_tokens"), 2).alias("percent"),
        F.round(F.col("raw_tokens") / F.col("stub_tokens"), 2).alias("ratio"), F.round(saved * 3.0 / 1e6, 6).alias("price"),
    )


def slow_requests(spark, sf):
    """The newest fifty requests that took a second or more."""
    rows = M.requests(table(spark, sf, "query_log")).where("total_ms >= 1000 AND NOT isnan(total_ms)")
    return rows.select("id", "tool", F.round("total_ms", 6).alias("total_ms")).orderBy(F.col("id").desc()).limit(50)


def symbol_matches(spark, sf):
    """The first fifty symbols that are named like a term of a question or begin with it, exact ones first."""
    terms = S.question_terms(table(spark, sf, "eval_items"), "item_id", "question").select("term").distinct()
    names = table(spark, sf, "symbols").where("id IS NOT NULL AND name IS NOT NULL").groupBy("id").agg(F.max("name").alias("name"), F.max("line").alias("line"))
    names = names.withColumn("word", F.lower("name"))
    cuts = F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.length("word"))), lambda n: F.substring(F.col("word"), F.lit(1), n))
    found = names.select("id", "name", "word", "line", F.explode(F.array_distinct(cuts)).alias("term")).join(S.small(terms), "term", "left_semi")
    exact = F.when(F.col("word") == F.col("term"), 0).otherwise(1)
    return G.first_per_key(found.withColumn("exact", exact), "term", [F.col("exact"), F.col("line"), F.col("id")], 50).select("term", "id", "name", "place")


def path_kinds(spark, sf):
    """Of every current file, whether it is a test and whether its path would be indexed."""
    path = F.col("filepath")
    # Directories that are never indexed, endings that are
    ignored = r"(?:^|/)(?:__pycache__|\.pytest_cache|\.tox|\.mypy_cache|\.ruff_cache|node_modules|dist|build|out|target|\.git|\.svn|\.hg|vendor|\.venv|venv)/"
    kept = r"\.(?:pyi?|js|ts|jsx|tsx|html|css|scss|json|md|ya?ml|toml|sh|bash|c|cpp|h|hpp|rs|go|java|sql|txt|rst)$"
    return current_files(table(spark, sf, "files")).select(
        "filepath", path.rlike(V.TEST_PATH).alias("is_test"), (path.rlike(kept) & ~path.rlike(ignored) & ~path.rlike(r"\.(?:min\.js|min\.css|bundle\.js|chunk\.js)$")).alias("indexed")
    )


def error_rate(spark, sf):
    """The share of current files with a stored diagnostic, in percent."""
    return store.error_density(spark, sf).agg(F.sum("n_files").alias("n_files"), F.sum("n_bad").alias("n_bad")).withColumn(
        "percent", F.when(F.col("n_files") > 0, F.round(F.col("n_bad") * 100.0 / F.col("n_files"), 2)).otherwise(0.0)
    )


def hotspots_stored(spark, sf):
    """The ten stored files with the most definitions."""
    stored = current_files(table(spark, sf, "files")).select("filepath")
    rows = table(spark, sf, "symbols").select("id", "filepath").distinct().join(stored, "filepath").groupBy("filepath").agg(F.count("*").alias("n"))
    return rows.orderBy(F.col("n").desc(), "filepath").limit(10)


def stale_files(spark, sf):
    """The first ten paths without a time of change, by name."""
    rows = table(spark, sf, "files").where("filepath IS NOT NULL AND (last_modified IS NULL OR last_modified = 0)").select("filepath").distinct()
    return rows.orderBy("filepath").limit(10)


def _notes(spark, sf, kind):
    return table(spark, sf, "documents").where((F.col("kind") == kind) & F.col("doc_id").isNotNull())


def latest_notes(spark, sf):
    """The newest session note of every project, with its size."""
    rows = _notes(spark, sf, "session_note").select(clean_project("project").alias("project"), "doc_id", "ingested_at", F.length("text").alias("size"))
    newest = Window.partitionBy("project").orderBy(F.col("ingested_at").desc_nulls_last(), F.col("doc_id").desc())
    return rows.withColumn("k", F.row_number().over(newest)).where("k = 1").select("project", "doc_id", "size")


def _notes_found(spark, sf, kind, k):
    docs = _notes(spark, sf, kind).select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    found = S.search(docs, {"text": 1.0}, S.question_terms(table(spark, sf, "eval_items"), "item_id", "question"), k)
    return found.select("query_id", "id", "rank", "score")


def search_notes(spark, sf):
    """The best three session notes for each question."""
    return _notes_found(spark, sf, "session_note", 3)


def search_skills(spark, sf):
    """The best twenty skills for each question."""
    return _notes_found(spark, sf, "skill", 20)


def agreement_summary(spark, sf):
    """Means of the agreement of two rankings over all questions, and whether recall passes a gate of 0.02 below 0.5."""
    rows = retrieval.eval_metrics(spark, sf)
    means = rows.agg(F.count("*").alias("n"), *[F.round(F.avg(c), 4).alias(c) for c in ("recall", "mrr", "ndcg")])
    return means.withColumn("passes", F.col("recall") >= 0.5 - 0.02)


def markdown_sections(spark, sf):
    """Headings of every readme outside of fences, with their level, line and the path of headings above."""
    docs = _notes(spark, sf, "readme").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    upto = Window.partitionBy("doc_id").orderBy("at")
    fence = F.col("line").rlike(r"^\s*```")
    docs = docs.withColumn("inside", F.sum(fence.cast("int")).over(upto) % 2 == 1).where("NOT inside")
    level = F.length(F.regexp_extract("line", r"^(#{1,6})\s+\S", 1))
    heads = docs.withColumn("level", level).where("level > 0").withColumn("name", F.trim(F.regexp_replace("line", r"^#{1,6}\s+", "")))
    # of each level the newest heading that no heading of a higher level has ended
    for n in range(1, 6):
        higher = F.max(F.when(F.col("level") < n, F.col("at"))).over(upto)
        own = F.max(F.when(F.col("level") == n, F.struct("at", "name"))).over(upto)
        heads = heads.withColumn(f"h{n}", F.when((F.col("level") > n) & (own["at"] > F.coalesce(higher, F.lit(-1))), own["name"]))
    return heads.select("doc_id", "level", (F.col("at") + 1).alias("line_no"), F.concat_ws(" > ", *[f"h{n}" for n in range(1, 6)], "name").alias("path"))


QUERIES = {
    f.__name__: f
    for f in (
        resolved_calls, test_callers, evidence_pack, evidence_items, extracted_symbols, token_savings, slow_requests, symbol_matches, path_kinds, error_rate, hotspots_stored,
        stale_files, latest_notes, search_notes, search_skills, agreement_summary, markdown_sections,
    )
}

_CALLS = f"""{store._REFS}, paths AS (SELECT id, max(filepath) AS filepath FROM chunks GROUP BY id),
calls AS (SELECT DISTINCT caller_id, callee, filepath FROM refs JOIN paths ON paths.id = refs.caller_id)"""
_TEST = V.TEST_PATH.replace("(?i)", "")
_STUB = f"""left(array_to_string(x[1:least({V.STUB_LINES}, coalesce(nullif(list_position(list_transform(x, lambda l: regexp_matches(l, '[:{{]\\s*$')), true), 0), {V.STUB_LINES}))], chr(10)), {V.STUB_SIGNS})"""
_EST = "CAST(greatest(1, floor(length({0}) / 4)) AS INTEGER)"
_SIZES = f"""sz AS (SELECT id, max(raw) AS raw, max(short) AS short FROM (SELECT id, {_EST.format('content')} AS raw, {_EST.format(_STUB)} AS short
  FROM (SELECT id, content, list_filter(string_split(content, chr(10)), lambda l: trim(l, ' ') <> '') AS x FROM {{0}})) GROUP BY id)"""


def _named(kind: str, k: int) -> str:
    """The search over one field of the documents of a kind."""
    sql = search._search("chunks", k)
    head, tail = sql.index("one AS ("), sql.index("tl AS (")
    sql = sql[:head] + f"tx AS (SELECT doc_id AS id, {search._words('text')} AS text FROM documents WHERE kind = '{kind}' AND doc_id IS NOT NULL),\n" + sql[tail:]
    old = " + ".join(f"len({c})" for c in search.WEIGHTS)
    placed = " UNION ALL ".join(f"SELECT id, n, '{c}' AS field, {w} AS w, unnest({c}) AS word, unnest(range(len({c}))) AS pos FROM tl" for c, w in search.WEIGHTS.items())
    return sql.replace(old, "len(text)").replace(placed, "SELECT id, n, 'text' AS field, 1.0 AS w, unnest(text) AS word, unnest(range(len(text))) AS pos FROM tl")


_KINDS = r"""regexp_matches(filepath, '\.(?:pyi?|js|ts|jsx|tsx|html|css|scss|json|md|ya?ml|toml|sh|bash|c|cpp|h|hpp|rs|go|java|sql|txt|rst)$')
  AND NOT regexp_matches(filepath, '(?:^|/)(?:__pycache__|\.pytest_cache|\.tox|\.mypy_cache|\.ruff_cache|node_modules|dist|build|out|target|\.git|\.svn|\.hg|vendor|\.venv|venv)/')
  AND NOT regexp_matches(filepath, '\.(?:min\.js|min\.css|bundle\.js|chunk\.js)$')"""
_OWN = "max(CASE WHEN level = {n} THEN pos END) OVER u"
_LEVELS = ", ".join(
    f"CASE WHEN level > {n} AND {_OWN.format(n=n)} > coalesce(max(CASE WHEN level < {n} THEN pos END) OVER u, -1) THEN last_value(CASE WHEN level = {n} THEN name END IGNORE NULLS) OVER u END AS h{n}"
    for n in range(1, 6)
)

_RESOLVED = rf"""{_CALLS},
df AS (SELECT id, max(name) AS name, max(filepath) AS path FROM symbols WHERE id IS NOT NULL AND name IS NOT NULL GROUP BY id),
dk AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY id) AS k, count(*) OVER (PARTITION BY name) AS n, regexp_extract(path, '([^/]*?)(?:\.[^./]*)?$', 1) AS stem FROM df),
im AS (SELECT DISTINCT filepath, unnest(regexp_extract_all(array_to_string(regexp_extract_all(content, '{V.IMPORT}', 1), ' '), '[A-Za-z_]\w*')) AS word FROM chunks WHERE filepath IS NOT NULL AND content IS NOT NULL),
tiers AS (
  SELECT caller_id, callee, id, 1 AS tier FROM calls JOIN dk ON dk.name = callee AND dk.path = calls.filepath
  UNION SELECT caller_id, callee, dk.id, 2 FROM calls JOIN im ON im.filepath = calls.filepath JOIN dk ON dk.name = callee AND dk.stem = im.word
  UNION SELECT caller_id, callee, dk.id, 2 FROM calls JOIN im ON im.filepath = calls.filepath AND im.word = callee JOIN dk ON dk.name = callee AND dk.k <= {V.IMPORTED}
  UNION SELECT caller_id, callee, dk.id, 3 FROM calls JOIN dk ON dk.name = callee AND dk.n = 1
  UNION SELECT caller_id, callee, dk.id, 4 FROM calls JOIN dk ON dk.name = callee AND dk.k <= {V.COMPOUND} WHERE len({search._parts('callee')}) >= 2
),
res AS (SELECT caller_id, callee, id AS definition_id, tier FROM (SELECT *, min(tier) OVER (PARTITION BY caller_id, callee) AS best FROM tiers) WHERE tier = best)"""
_DEFINED = ", ".join(
    "coalesce(" + ", ".join(f"CASE WHEN e IN ({', '.join(repr(x) for x in ENDINGS[k])}) THEN regexp_extract(line, '{p}', {g}) END" for k, p in DEFINES.items()) + f") AS g{g}" for g in (1, 2)
)

SQL = {
    "evidence_items": f"""WITH {search._search('chunks', search.K)}, {_RESOLVED},
loc AS (SELECT s.id AS definition_id, min(c.id) AS callee_id FROM symbols AS s JOIN chunks AS c ON c.filepath = s.filepath AND c.symbol_name = s.name AND s.line BETWEEN c.start_line AND c.end_line
  WHERE s.id IS NOT NULL AND c.id IS NOT NULL GROUP BY s.id),
cl AS (SELECT caller_id, callee_id, dense_rank() OVER (PARTITION BY caller_id ORDER BY callee) AS place FROM res JOIN loc USING (definition_id) WHERE caller_id <> callee_id),
kd AS (SELECT id, max(chunk_type) AS kind, max(parent_id) AS parent_id FROM chunks WHERE id IS NOT NULL GROUP BY id),
sd AS (SELECT query_id, id, CASE WHEN kind = 'module' THEN score * {V.MODULE_FACTOR}::DOUBLE ELSE score END AS score, parent_id FROM found JOIN kd USING (id) WHERE rank <= 5),
bk AS (SELECT caller_id, callee_id FROM (SELECT *, row_number() OVER (PARTITION BY callee_id ORDER BY caller_id) AS k FROM (SELECT DISTINCT caller_id, callee_id FROM cl)) WHERE k <= {V.CALLS_PER_SEED}),
ei AS (
  SELECT query_id, id, 0 AS o, 'seed' AS role, score FROM sd
  UNION ALL SELECT query_id, kd.id, 1, 'parent', score * {V.PARENT_FACTOR}::DOUBLE FROM sd JOIN kd ON kd.id = sd.parent_id AND kd.kind = 'class_header'
  UNION ALL SELECT query_id, callee_id, 2, 'callee', score * {V.CALL_FACTOR}::DOUBLE FROM sd JOIN cl ON cl.caller_id = sd.id AND place <= {V.CALLS_PER_SEED}
  UNION ALL SELECT query_id, caller_id, 3, 'caller', score * {V.CALL_FACTOR}::DOUBLE FROM sd JOIN bk ON bk.callee_id = sd.id
)
SELECT query_id, id, min_by(role, o) AS role, max(score) AS score FROM ei GROUP BY query_id, id""",
    "extracted_symbols": rf"""WITH l AS (SELECT filepath, sha256, lower(regexp_extract(filepath, '\.(\w+)$', 1)) AS e, generate_subscripts(x, 1) AS line_no, unnest(x) AS line
  FROM (SELECT filepath, sha256, string_split(content, chr(10)) AS x FROM raw_sources WHERE filepath IS NOT NULL AND content IS NOT NULL)), g AS (SELECT *, {_DEFINED} FROM l)
SELECT DISTINCT filepath, sha256, CAST(line_no AS INTEGER) AS line, g2 AS name, CASE WHEN g1 IN ({', '.join(repr(x) for x in CONTAINERS)}) THEN 'class' ELSE 'def' END AS symbol_type,
  left(trim(regexp_replace(line, '\s+', ' ', 'g'), ' '), 120) AS signature FROM g WHERE g2 <> ''""",
    "resolved_calls": f"WITH {_RESOLVED} SELECT * FROM res",
    "test_callers": f"""WITH {_CALLS} SELECT callee, filepath, caller_id, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY callee ORDER BY filepath, caller_id) AS place
FROM calls WHERE regexp_matches(filepath, '{_TEST}', 'i')) WHERE place <= 10""",
    "evidence_pack": f"""WITH RECURSIVE {search._search('chunks', search.K)},
{_SIZES.replace("{0}", "(SELECT id, coalesce(content, '') AS content FROM chunks)")},
it AS (SELECT query_id, found.id, rank, raw, short FROM found JOIN sz ON sz.id = found.id),
fold AS (
  SELECT query_id, id, rank, CASE WHEN raw <= {BUDGET * V.BODY_SHARE} THEN 'body' ELSE 'stub' END AS form, CASE WHEN raw <= {BUDGET * V.BODY_SHARE} THEN raw ELSE short END AS cost,
    CASE WHEN raw <= {BUDGET * V.BODY_SHARE} THEN raw ELSE short END AS used FROM it WHERE rank = 1
  UNION ALL
  SELECT it.query_id, it.id, it.rank,
    CASE WHEN used + raw <= {BUDGET * V.BODY_SHARE} THEN 'body' WHEN used + short <= {BUDGET} THEN 'stub' ELSE 'omitted' END,
    CASE WHEN used + raw <= {BUDGET * V.BODY_SHARE} THEN raw WHEN used + short <= {BUDGET} THEN short ELSE 0 END,
    used + CASE WHEN used + raw <= {BUDGET * V.BODY_SHARE} THEN raw WHEN used + short <= {BUDGET} THEN short ELSE 0 END
  FROM fold JOIN it ON it.query_id = fold.query_id AND it.rank = fold.rank + 1
)
SELECT query_id, id, rank, form, cost FROM fold""",
    "token_savings": f"""WITH {_SIZES.replace("{0}", "(SELECT id, content FROM chunks WHERE id IS NOT NULL AND content IS NOT NULL)")},
s AS (SELECT CAST(sum(raw) AS BIGINT) AS raw_tokens, CAST(sum(short) AS BIGINT) AS stub_tokens FROM sz), g AS (SELECT *, greatest(0, raw_tokens - stub_tokens) AS saved FROM s)
SELECT *, round(saved * 100.0::DOUBLE / raw_tokens, 2) AS percent, round(raw_tokens / stub_tokens, 2) AS ratio, round(saved * 3.0::DOUBLE / 1e6, 6) AS price FROM g""",
    "slow_requests": f"WITH {store._LOG} SELECT id, tool, round(total_ms, 6) AS total_ms FROM log WHERE total_ms >= 1000 AND NOT isnan(total_ms) ORDER BY id DESC LIMIT 50",
    "symbol_matches": f"""WITH {search._QUESTIONS}, nm AS (SELECT id, max(name) AS name, max(line) AS line FROM symbols WHERE id IS NOT NULL AND name IS NOT NULL GROUP BY id)
SELECT term, id, name, CAST(place AS INTEGER) AS place FROM (SELECT term, id, name, row_number() OVER (PARTITION BY term ORDER BY lower(name) <> term, line NULLS FIRST, id) AS place
FROM (SELECT DISTINCT term FROM asked) JOIN nm ON starts_with(lower(name), term)) WHERE place <= 50""",
    "path_kinds": f"WITH {store._FILES} SELECT filepath, regexp_matches(filepath, '{_TEST}', 'i') AS is_test, {_KINDS} AS indexed FROM cur",
    "error_rate": f"""SELECT CAST(sum(n_files) AS BIGINT) AS n_files, CAST(sum(n_bad) AS BIGINT) AS n_bad, round(sum(n_bad) * 100.0::DOUBLE / sum(n_files), 2) AS percent FROM ({store.SQL['error_density']})""",
    "hotspots_stored": "SELECT filepath, count(*) AS n FROM (SELECT DISTINCT id, filepath FROM symbols) WHERE filepath IN (SELECT filepath FROM files) GROUP BY filepath ORDER BY n DESC, filepath LIMIT 10",
    "stale_files": "SELECT DISTINCT filepath FROM files WHERE filepath IS NOT NULL AND (last_modified IS NULL OR last_modified = 0) ORDER BY filepath LIMIT 10",
    "latest_notes": f"""SELECT project, doc_id, CAST(length(text) AS INTEGER) AS size FROM (SELECT {store._PROJECT} AS project, doc_id, text,
  row_number() OVER (PARTITION BY {store._PROJECT} ORDER BY ingested_at DESC NULLS LAST, doc_id DESC) AS k FROM documents WHERE kind = 'session_note' AND doc_id IS NOT NULL) WHERE k = 1""",
    "search_notes": f"WITH {_named('session_note', 3)} SELECT query_id, id, rank, score FROM found",
    "search_skills": f"WITH {_named('skill', 20)} SELECT query_id, id, rank, score FROM found",
    "agreement_summary": f"""WITH m AS ({retrieval.SQL['eval_metrics']}), s AS (SELECT count(*) AS n, round(avg(recall), 4) AS recall, round(avg(mrr), 4) AS mrr, round(avg(ndcg), 4) AS ndcg FROM m)
SELECT *, recall >= 0.48 AS passes FROM s""",
    "markdown_sections": rf"""WITH l AS (SELECT doc_id, generate_subscripts(x, 1) - 1 AS pos, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE kind = 'readme' AND doc_id IS NOT NULL AND text IS NOT NULL)),
f AS (SELECT *, sum(regexp_matches(line, '^\s*```')::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos) % 2 = 1 AS inside FROM l),
h AS (SELECT doc_id, pos, length(regexp_extract(line, '^(#{{1,6}})\s+\S', 1)) AS level, trim(regexp_replace(line, '^#{{1,6}}\s+', ''), ' ') AS name FROM f WHERE NOT inside),
p AS (SELECT *, {_LEVELS} FROM (SELECT * FROM h WHERE level > 0) WINDOW u AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, CAST(level AS INTEGER) AS level, CAST(pos + 1 AS INTEGER) AS line_no, concat_ws(' > ', h1, h2, h3, h4, h5, name) AS path FROM p""",
}
