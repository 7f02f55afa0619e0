"""Queries that search chunks as code."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import terms as T
from loomspark.operators import lexical as L
from loomspark.operators import search as S
from loomspark.session import cut
from loomspark.sources.tables import clean_project, current_files, table

K = 20
# Weights of the fields
WEIGHTS = {"name": 8.0, "qualified_name": 6.0, "filepath": 2.0, "content": 1.0, "idents": 1.0}
POOL = 50


def _terms(spark, sf):
    return S.question_terms(table(spark, sf, "eval_items"), "item_id", "question")


def _chunks(spark, sf):
    return S.one_row_per_id(table(spark, sf, "chunks"), "id", ["name", "qualified_name", "filepath", "content"])


def question_terms(spark, sf):
    """Expanded terms of every question, and which of them are base words."""
    return _terms(spark, sf)


def identifier_index(spark, sf):
    """Identifier parts of every chunk: how many there are, and the first and last."""
    rows = S.code_fields(_chunks(spark, sf)).select("id", F.filter(F.split("idents", " "), lambda w: w != "").alias("w"))
    return rows.select("id", F.size("w").alias("n"), F.array_min("w").alias("least"), F.array_max("w").alias("greatest"))


def search_chunks(spark, sf):
    """The best chunks for each question by prefix, AND and NEAR groups over weighted fields."""
    return S.search(S.code_fields(_chunks(spark, sf)), WEIGHTS, _terms(spark, sf), K)


def search_narrowed(spark, sf):
    """The same among Python and Go code of files touched since a given time, in paths below a prefix of some project."""
    chunks = table(spark, sf, "chunks").withColumn("language", F.lower(F.trim("language")))
    chunks = S.narrowed(chunks, current_files(table(spark, sf, "files")), languages=["python", "go"], types=["code", "class_header"], since=1.7e9)
    rows = S.one_row_per_id(chunks, "id", ["name", "qualified_name", "filepath", "content"])
    return S.search(S.code_fields(rows), WEIGHTS, _terms(spark, sf), K)


def search_ranked(spark, sf):
    """The candidates of each question blended with centrality and exact symbols, diverse by file."""
    chunks = S.code_fields(_chunks(spark, sf))
    listed = L.ranked(S.search(chunks, WEIGHTS, _terms(spark, sf), POOL), POOL)
    symbols = table(spark, sf, "symbols").where("name IS NOT NULL").withColumn("project", clean_project("project"))
    # how many definitions a name has stands for its links
    n = symbols.groupBy("project", F.col("name").alias("name")).agg(F.countDistinct("id").alias("n"))
    top = n.groupBy(F.col("project").alias("of")).agg(F.max("n").alias("most"))
    central = n.join(top, F.col("project").eqNullSafe(F.col("of"))).groupBy("name").agg(F.max(F.log1p("n") / F.log1p("most")).alias("score"))
    names = table(spark, sf, "chunks").groupBy("id").agg(F.max("qualified_name").alias("name"), F.max("filepath").alias("filepath"))
    blend = S.blended(listed, names.select("id", F.coalesce("name", F.lit("")).alias("name")), _terms(spark, sf), central)
    return L.diversify(blend.join(names.select("id", "filepath"), "id"), "filepath").select("query_id", "id", "score", "place")


def search_tail(spark, sf):
    """Scores of the candidates behind the first 30 of each question, below the least of these."""
    listed = S.search(S.code_fields(_chunks(spark, sf)), WEIGHTS, _terms(spark, sf), POOL)
    return S.with_tail(listed.where("rank <= 30"), listed, 30)


def search_snippets(spark, sf):
    """The words around the matches in the best five chunks of each question."""
    chunks, terms = _chunks(spark, sf), _terms(spark, sf)
    hits = cut(S.search(S.code_fields(chunks), WEIGHTS, terms, 5).select("query_id", "id"), "snippet-hits")
    texts = chunks.join(S.small(hits.select("id").distinct()), "id", "left_semi").select("id", F.coalesce("content", F.lit("")).alias("text"))
    return S.snippets(hits, texts, terms)


QUERIES = {f.__name__: f for f in (question_terms, identifier_index, search_chunks, search_narrowed, search_ranked, search_tail, search_snippets)}

_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def _parts(w: str) -> str:
    return rf"list_filter(string_split(lower(regexp_replace(regexp_replace({w}, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '([A-Z])([A-Z][a-z])', '\1_\2', 'g')), '_'), lambda p: p <> '')"


def _idents(c: str) -> str:
    """Distinct parts of the identifiers of a text that have several, as a list."""
    return rf"list_distinct(flatten(list_filter(list_transform(list_distinct(regexp_extract_all(coalesce({c}, ''), '{T.IDENTIFIER}')), lambda w: {_parts('w')}), lambda p: len(p) > 1)))"


_QUESTIONS = rf"""qw AS (SELECT item_id AS query_id, unnest(regexp_extract_all(question, '[\pL\pN_]+')) AS w FROM eval_items WHERE item_id IS NOT NULL AND question IS NOT NULL),
qp AS (SELECT query_id, {_parts('w')} AS p FROM qw),
qb AS (SELECT DISTINCT query_id, t FROM (SELECT query_id, unnest(p) AS t FROM qp) WHERE length(t) >= 2 AND t NOT IN ({_STOP})),
qt AS (SELECT DISTINCT query_id, t FROM (SELECT query_id, unnest(CASE WHEN len(p) > 1 THEN list_concat(p, [array_to_string(p, ''), array_to_string(p, '_')]) ELSE p END) AS t FROM qp)
  WHERE length(t) >= 2 AND t NOT IN ({_STOP})),
asked AS (SELECT qt.query_id, qt.t AS term, qb.t IS NOT NULL AS core FROM qt LEFT JOIN qb ON qb.query_id = qt.query_id AND qb.t = qt.t)"""
_ONE = """one AS (SELECT id, max(row(name, qualified_name, filepath, content)) AS r FROM {0} WHERE id IS NOT NULL GROUP BY id),
doc AS (SELECT id, r[1] AS name, r[2] AS qualified_name, r[3] AS filepath, r[4] AS content FROM one)"""


def _words(c: str) -> str:
    return rf"regexp_extract_all(lower(coalesce({c}, '')), '[\pL\pN]+')"


def _search(source: str, k: int) -> str:
    fields = {
        "name": "name", "qualified_name": f"coalesce(qualified_name, '') || ' ' || array_to_string({_idents('qualified_name')}, ' ')", "filepath": "filepath", "content": "content",
        "idents": "array_to_string(" + _idents("concat_ws(' ', name, content)") + ", ' ')",
    }
    texts = ", ".join(f"{_words(x)} AS {c}" for c, x in fields.items())
    size = " + ".join(f"len({c})" for c in fields)
    placed = " UNION ALL ".join(f"SELECT id, n, '{c}' AS field, {w} AS w, unnest({c}) AS word, unnest(range(len({c}))) AS pos FROM tl" for c, w in WEIGHTS.items())
    part = "i.idf * x.tf * 2.2 / (x.tf + 1.2 * (0.25 + 0.75 * x.n / st.avg_len))"
    idf = "CASE WHEN ln((st.n_docs - c + 0.5) / (c + 0.5)) > 0 THEN ln((st.n_docs - c + 0.5) / (c + 0.5)) ELSE 1e-6 END"
    return f"""{_QUESTIONS}, {_ONE.format(source)},
tx AS (SELECT id, {texts} FROM doc),
tl AS (SELECT *, {size} AS n FROM tx),
st AS (SELECT count(*) AS n_docs, avg(n) AS avg_len FROM tl),
pl AS ({placed}),
mt AS (SELECT v.word, a.term FROM (SELECT DISTINCT word FROM pl) AS v JOIN (SELECT DISTINCT term FROM asked) AS a ON starts_with(v.word, a.term)),
bx AS (SELECT id, n, term, sum(w) AS tf FROM pl JOIN mt USING (word) GROUP BY id, n, term),
bi AS (SELECT term, {idf} AS idf FROM (SELECT term, count(*) AS c FROM bx GROUP BY term), st),
bs AS (SELECT query_id, x.id, sum({part}) AS part FROM bx AS x JOIN bi AS i USING (term) JOIN asked USING (term), st GROUP BY query_id, x.id),
co AS (SELECT query_id, term, count(*) OVER (PARTITION BY query_id) AS n_core FROM asked WHERE core),
cx AS (SELECT id, n, word AS term, sum(w) AS tf FROM pl WHERE word IN (SELECT term FROM co WHERE n_core > 1) GROUP BY id, n, word),
ci AS (SELECT term, {idf} AS idf FROM (SELECT term, count(*) AS c FROM cx GROUP BY term), st),
ev AS (SELECT query_id, x.id, n_core, sum({part}) AS part FROM cx AS x JOIN ci AS i USING (term) JOIN co USING (term), st WHERE n_core > 1 GROUP BY query_id, x.id, n_core HAVING count(*) = n_core),
nr AS (SELECT ev.query_id, ev.id, ev.n_core, ev.part, pl.field, pl.pos, pl.word FROM ev JOIN co USING (query_id) JOIN pl ON pl.id = ev.id AND pl.word = co.term),
nd AS (SELECT query_id, id, max(part) AS part FROM (SELECT *, len(list_distinct(list(word) OVER (PARTITION BY query_id, id, field ORDER BY pos RANGE BETWEEN CURRENT ROW AND {S.NEAR + 1} FOLLOWING))) AS c FROM nr) WHERE c = n_core GROUP BY query_id, id),
su AS (SELECT query_id, id, round(sum(part), 6) AS score FROM (SELECT query_id, id, part FROM bs UNION ALL SELECT query_id, id, part FROM ev UNION ALL SELECT query_id, id, part FROM nd) GROUP BY query_id, id),
found AS (SELECT * FROM (SELECT query_id, id, CASE WHEN score = 0 THEN {S.LEAST} ELSE score END AS score,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN score = 0 THEN {S.LEAST} ELSE score END DESC, id) AS INTEGER) AS rank FROM su) WHERE rank <= {k})"""


_NARROW = """(SELECT * FROM chunks WHERE lower(trim(language)) IN ('python', 'go') AND chunk_type IN ('code', 'class_header') AND filepath IN
  (SELECT filepath FROM (SELECT filepath, max(last_modified) AS m FROM files GROUP BY filepath) WHERE m >= 1.7e9))"""
_LAST = "string_split(string_split(coalesce(name, ''), '.')[-1], ' ')[1]"


def _scaled(c: str) -> str:
    return f"CASE WHEN max({c}) OVER q > min({c}) OVER q THEN ({c} - min({c}) OVER q) / (max({c}) OVER q - min({c}) OVER q) WHEN {c} > 0 THEN 1.0 ELSE 0.0 END"


SQL = {
    "question_terms": f"WITH {_QUESTIONS} SELECT * FROM asked",
    "identifier_index": f"""WITH {_ONE.format('chunks')}, w AS (SELECT id, {_idents("concat_ws(' ', name, content)")} AS w FROM doc)
SELECT id, CAST(len(w) AS INTEGER) AS n, list_min(w) AS least, list_max(w) AS greatest FROM w""",
    "search_chunks": f"WITH {_search('chunks', K)} SELECT * FROM found",
    "search_narrowed": f"WITH {_search(_NARROW, K)} SELECT * FROM found",
    "search_ranked": f"""WITH {_search('chunks', POOL)},
d AS (SELECT nullif(lower(trim(project)), '') AS project, name, count(DISTINCT id) AS n FROM symbols WHERE name IS NOT NULL GROUP BY 1, 2),
cen AS (SELECT name, max(s) AS central FROM (SELECT name, ln(1 + n) / ln(1 + max(n) OVER (PARTITION BY project)) AS s FROM d) GROUP BY name),
nm AS (SELECT id, max(filepath) AS filepath, {_LAST.replace('name', 'max(qualified_name)')} AS name FROM chunks GROUP BY id),
b AS (SELECT f.query_id, f.id, f.rank, f.score AS fused, coalesce(cen.central, 0) AS central, filepath,
  EXISTS (SELECT 1 FROM asked WHERE asked.query_id = f.query_id AND asked.term = lower(nm.name)) AS exact FROM found AS f JOIN nm USING (id) LEFT JOIN cen ON cen.name = nm.name),
s AS (SELECT *, round(0.7::DOUBLE * {_scaled('fused')} + 0.25::DOUBLE * {_scaled('central')} + 0.05::DOUBLE * exact::INTEGER, 6) AS score FROM b WINDOW q AS (PARTITION BY query_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS k FROM s),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, filepath ORDER BY k) <= 3 AS fits FROM r),
t AS (SELECT *, fits AND row_number() OVER (PARTITION BY query_id, fits ORDER BY k) <= 10 AS front FROM o)
SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY front DESC, k) AS INTEGER) AS place FROM t""",
    "search_snippets": f"""WITH {_search('chunks', 5)},
tm AS (SELECT query_id, list(DISTINCT term) AS terms FROM asked GROUP BY query_id),
sn AS (SELECT f.query_id, f.id, tx.content AS w, list_transform(tx.content, lambda x: len(list_filter(tm.terms, lambda t: starts_with(x, t))) > 0) AS h FROM found AS f JOIN tx USING (id) JOIN tm USING (query_id)),
wn AS (SELECT *, unnest(range(1, greatest(1, len(w) - 31) + 1)) AS a FROM sn),
bs2 AS (SELECT *, len(list_filter(h[a:a + 31], lambda x: x)) AS n FROM wn),
one2 AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY n DESC, a) AS k FROM bs2)
SELECT query_id, id, CAST(a AS INTEGER) AS begin, CAST(n AS INTEGER) AS n_marked,
  array_to_string(list_transform(list_zip(w[a:a + 31], h[a:a + 31]), lambda x: CASE WHEN x[2] THEN '«' || x[1] || '»' ELSE x[1] END), ' ') AS snippet FROM one2 WHERE k = 1""",
    "search_tail": f"""WITH {_search('chunks', POOL)}, fl AS (SELECT query_id, min(score) AS low, (SELECT count(*) FROM found AS g WHERE g.query_id = f.query_id AND g.rank > 30) AS n FROM found AS f WHERE rank <= 30 GROUP BY query_id)
SELECT query_id, id, CASE WHEN rank <= 30 THEN score ELSE round(low * (1 - (rank - 30) / (n + 1)::DOUBLE), 6) END AS score, rank FROM found JOIN fl USING (query_id)""",
}
