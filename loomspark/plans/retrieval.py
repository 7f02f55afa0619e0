"""Ranked retrieval over ``documents`` and ``chunks``, and nearest vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.operators import lexical as L
from loomspark.operators import metrics as M
from loomspark.operators import vectors as V
from loomspark.session import cut
from loomspark.sources.tables import table

K = 20
# Weights of the fields
WEIGHTS = {"name": 8.0, "qualified_name": 6.0, "filepath": 2.0, "content": 1.0}


def _asked(spark, sf):
    return L.query_words(table(spark, sf, "eval_items"), "item_id", "question")


def token_doc_freq(spark, sf):
    """Documents and hits of every word of ``documents``."""
    docs = table(spark, sf, "documents").select("doc_id", F.explode(L.words(F.col("text"))).alias("term"))
    one = docs.groupBy("term", "doc_id").agg(F.count("*").alias("hits"))
    return one.groupBy("term").agg(F.count("*").alias("n_docs"), F.sum("hits").alias("hits"))


def bm25_documents(spark, sf):
    """The best documents for each question."""
    return L.bm25(table(spark, sf, "documents"), "doc_id", {"text": 1.0}, _asked(spark, sf), K, unique=True)


def bm25_chunks_weighted(spark, sf):
    """The best chunks for each question, with weights of the columns."""
    return L.bm25(table(spark, sf, "chunks"), "id", WEIGHTS, _asked(spark, sf), K)


def bm25_filtered(spark, sf):
    """The best code chunks with a symbol for each question; statistics of that scope."""
    scope = table(spark, sf, "chunks").where("chunk_type = 'code' AND symbol_name IS NOT NULL")
    return L.bm25(scope, "id", WEIGHTS, _asked(spark, sf), K)


def _lists(spark, sf):
    """The postings of the chunks, and the words of the questions, from which every list is scored."""
    asked = _asked(spark, sf)
    return L.postings(table(spark, sf, "chunks"), "id", list(WEIGHTS), asked.select("term").distinct()), asked


def _fused(found, asked):
    return L.fuse([L.score(found, {c: 1.0}, asked, 50) for c in ("name", "content")], K)


def rrf_fusion(spark, sf):
    """Fusion of the rankings by name and by content."""
    asked = _asked(spark, sf)
    return _fused(L.postings(table(spark, sf, "chunks"), "id", ["name", "content"], asked.select("term").distinct()), asked)


def diversified(spark, sf):
    """The weighted ranking with scaled scores and at most three chunks of a file in front."""
    chunks = table(spark, sf, "chunks")
    best = L.min_max(bm25_chunks_weighted(spark, sf))
    paths = chunks.join(F.broadcast(best.select("id").distinct()), "id", "left_semi").groupBy("id").agg(F.max("filepath").alias("filepath"))
    return L.diversify(best.join(paths, "id"), "filepath").select("query_id", "id", "scaled", "rank", "place")


def eval_metrics(spark, sf):
    """How well the fused ranking finds the first five of the weighted one, per question."""
    found, asked = _lists(spark, sf)
    return M.quality(_fused(found, asked), L.score(found, WEIGHTS, asked, K).where("rank <= 5"), 10)


def knn(spark, sf):
    """The nearest vectors to each vector whose id is divisible by 50."""
    base = table(spark, sf, "embeddings")
    return V.nearest(base, base.where("vec_id % 50 = 0"), 10)


def knn_filtered(spark, sf):
    """As ``knn``, among the vectors of labels below 5."""
    base = table(spark, sf, "embeddings")
    return V.nearest(base.where("label < 5"), base.where("vec_id % 50 = 0"), 10)


def hybrid_candidates(spark, sf):
    """For each question the best documents and the vectors nearest to the first of them, fused by reciprocal rank."""
    listed = cut(L.bm25(table(spark, sf, "documents"), "doc_id", {"text": 1.0}, _asked(spark, sf), 50, unique=True), "hybrid-lexical")
    base = table(spark, sf, "embeddings")
    first = listed.where("rank = 1").select("query_id", F.col("id").alias("vec_id"))
    near = V.nearest(base, base.join(first.select("vec_id").distinct(), "vec_id", "left_semi"), 20)
    near = near.join(first.select(F.col("query_id").alias("q"), F.col("vec_id").alias("query_id")), "query_id").select(F.col("q").alias("query_id"), "id", F.col("rank").alias("near"))
    both = listed.select("query_id", "id", "rank").join(near, ["query_id", "id"], "full_outer")
    vote = lambda c: F.coalesce(1.0 / (60 + F.col(c)), F.lit(0.0))
    return both.select("query_id", "id", F.col("rank").alias("lexical_rank"), F.col("near").alias("vector_rank"), F.round(vote("rank") + vote("near"), 9).alias("score"))


def l2_normalize(spark, sf):
    """Every vector at length one: its length and first value."""
    rows = table(spark, sf, "embeddings").select("vec_id", V.l2_normalize(F.col("embedding")).alias("v"))
    return rows.select("vec_id", F.round(V.norm(F.col("v")), 6).alias("length"), F.round(F.col("v")[0], 6).alias("first"))


def missing_embeddings(spark, sf):
    """Documents without a vector."""
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "embeddings"), F.col("doc_id") == F.col("vec_id"), "left_anti")


QUERIES = {
    f.__name__: f
    for f in (token_doc_freq, bm25_documents, bm25_chunks_weighted, bm25_filtered, rrf_fusion, diversified, eval_metrics, knn, knn_filtered, hybrid_candidates, l2_normalize, missing_embeddings)
}


def _words(c: str) -> str:
    return rf"regexp_extract_all(lower(coalesce({c}, '')), '[\p{{L}}\p{{N}}]+')"


_ASKED = f"asked AS (SELECT DISTINCT item_id AS query_id, unnest({_words('question')}) AS term FROM eval_items)"


def _bm25(tag: str, source: str, id_col: str, weights: dict[str, float], k: int) -> str:
    cols = ", ".join(weights)
    size = " + ".join(f"len({_words(c)})" for c in weights)
    each = " UNION ALL ".join(f"SELECT id, unnest({_words(c)}) AS term, {x} AS w FROM {tag}b" for c, x in weights.items())
    return f"""{tag}b AS (SELECT DISTINCT {id_col} AS id, {cols} FROM {source}),
{tag}l AS (SELECT id, {size} AS len FROM {tag}b),
{tag}h AS (SELECT id, term, sum(w) AS tf FROM ({each}) WHERE term IN (SELECT term FROM asked) GROUP BY id, term),
{tag}s AS (SELECT count(*) AS n_docs, avg(len) AS avg_len FROM {tag}l),
{tag}i AS (SELECT term, ln((n_docs - n + 0.5) / (n + 0.5)) AS idf FROM (SELECT term, count(*) AS n FROM {tag}h GROUP BY term), {tag}s),
{tag}r AS (
  SELECT query_id, h.id, round(sum(CASE WHEN idf > 0 THEN idf ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score
  FROM {tag}h AS h JOIN {tag}i USING (term) JOIN asked USING (term) JOIN {tag}l AS l ON l.id = h.id, {tag}s GROUP BY query_id, h.id),
{tag} AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM {tag}r) WHERE rank <= {k})"""


_SCOPE = "chunks WHERE chunk_type = 'code' AND symbol_name IS NOT NULL"
_COSINE = "list_dot_product(q.v, b.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(b.v, b.v))"


def _knn(where: str) -> str:
    return f"""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT q.vec_id AS query_id, b.vec_id AS id, round(1 - {_COSINE}, 6) + 0.0 AS distance FROM e AS q, e AS b WHERE q.vec_id % 50 = 0 AND {where})
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank FROM d) WHERE rank <= 10"""


_FUSED = f"""{_bm25('f', 'chunks', 'id', {'name': 1.0}, 50)}, {_bm25('g', 'chunks', 'id', {'content': 1.0}, 50)},
v AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT * FROM f UNION ALL SELECT * FROM g) GROUP BY query_id, id),
u AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM v) WHERE rank <= {K})"""

SQL = {
    "eval_metrics": f"""WITH {_ASKED}, {_FUSED}, {_bm25('x', 'chunks', 'id', WEIGHTS, K)},
y AS (SELECT x.query_id, u.rank FROM x LEFT JOIN u ON u.query_id = x.query_id AND u.id = x.id WHERE x.rank <= 5),
z AS (SELECT query_id, count(*) AS k, count(*) FILTER (WHERE rank <= 10) AS hits, min(rank) AS best, coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE rank <= 10), 0) AS dcg FROM y GROUP BY query_id)
SELECT query_id, k AS n_expected, round(hits / k, 6) AS recall, round(coalesce(1 / best, 0), 6) AS mrr,
  round(dcg / list_sum(list_transform(range(1, k + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM z""",
    "token_doc_freq": f"""SELECT term, count(DISTINCT doc_id) AS n_docs, count(*) AS hits
FROM (SELECT doc_id, unnest({_words('text')}) AS term FROM documents) GROUP BY term""",
    "bm25_documents": f"WITH {_ASKED}, {_bm25('f', 'documents', 'doc_id', {'text': 1.0}, K)} SELECT * FROM f",
    "bm25_chunks_weighted": f"WITH {_ASKED}, {_bm25('f', 'chunks', 'id', WEIGHTS, K)} SELECT * FROM f",
    "bm25_filtered": f"WITH {_ASKED}, {_bm25('f', _SCOPE, 'id', WEIGHTS, K)} SELECT * FROM f",
    "rrf_fusion": f"WITH {_ASKED}, {_FUSED} SELECT * FROM u",
    "diversified": f"""WITH {_ASKED}, {_bm25('f', 'chunks', 'id', WEIGHTS, K)},
p AS (SELECT id, max(filepath) AS filepath FROM chunks GROUP BY id),
m AS (SELECT *, min(score) OVER q AS low, max(score) OVER q AS high FROM f JOIN p USING (id) WINDOW q AS (PARTITION BY query_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, filepath ORDER BY rank) <= 3 AS fits FROM m),
t AS (SELECT *, fits AND row_number() OVER (PARTITION BY query_id, fits ORDER BY rank) <= 10 AS front FROM o)
SELECT query_id, id, round(CASE WHEN high > low THEN (score - low) / (high - low) WHEN score > 0 THEN 1.0 ELSE 0.0 END, 6) AS scaled, rank,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY front DESC, rank) AS INTEGER) AS place FROM t""",
    "knn": _knn("true"),
    "knn_filtered": _knn("b.label < 5"),
    "hybrid_candidates": f"""WITH {_ASKED}, {_bm25('f', 'documents', 'doc_id', {'text': 1.0}, 50)},
e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT f.query_id, b.vec_id AS id, round(1 - {_COSINE}, 6) + 0.0 AS distance FROM f JOIN e AS q ON q.vec_id = f.id AND f.rank = 1, e AS b),
n AS (SELECT * FROM (SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS near FROM d) WHERE near <= 20)
SELECT coalesce(f.query_id, n.query_id) AS query_id, coalesce(f.id, n.id) AS id, f.rank AS lexical_rank, n.near AS vector_rank,
  round(coalesce(1.0::DOUBLE / (60 + f.rank), 0) + coalesce(1.0::DOUBLE / (60 + n.near), 0), 9) AS score
FROM f FULL JOIN n ON n.query_id = f.query_id AND n.id = f.id""",
    "l2_normalize": """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS s FROM e)
SELECT vec_id, CAST(round(sqrt(list_sum(list_transform(v, lambda x: (x / s) * (x / s)))), 6) AS DOUBLE) AS length, round(v[1] / s, 6) AS first FROM n""",
    "missing_embeddings": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
}
