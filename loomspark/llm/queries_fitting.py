"""Queries that fit texts to token limits: packed containers and split pieces."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.llm import packing as P
from loomspark.llm import splitting as S
from loomspark.sources.tables import table


def p5_packing(spark, sf):
    """The container and step group of every text, in tokens."""
    return P.pack_texts(table(spark, sf, "documents"))


def p5_fill(spark, sf):
    """Containers and unused share by tier."""
    return P.fill_report(P.pack_texts(table(spark, sf, "documents")))


def p5_whole(spark, sf):
    """What must hold of ``p5_packing``: texts placed, and places, windows and parts that break a rule."""
    placed = p5_packing(spark, sf)
    size = P.window_sizes(P.CAPACITY, P.TIERS)
    room = F.element_at(F.array(*[F.lit(x) for x in size]), F.col("window_tier") + 1)
    over = placed.groupBy("container").agg(F.sum("n_tokens").alias("t")).where(F.col("t") > P.CAPACITY)
    tight = placed.groupBy("window", "window_tier").agg(F.sum("n_tokens").alias("t")).where(F.col("t") > room)
    item = placed.groupBy("item").agg(F.min("begin").alias("a"), F.max("until").alias("b"), F.sum("n_tokens").alias("t"), F.count("*").alias("k"))
    torn = (F.col("a") != 0) | (F.col("b") != F.col("t")) | (F.col("k") != F.ceil(F.col("b") / P.CAPACITY))
    counted = item.agg(F.count("*").alias("n_items"), F.count(F.when(torn, 1)).alias("n_torn"))
    return counted.join(over.agg(F.count("*").alias("n_over"))).join(tight.agg(F.count("*").alias("n_tight")))


def p7_pieces(spark, sf):
    """Overlapping pieces of every text above the limit."""
    return S.split_texts(table(spark, sf, "documents"))


def p7_boundaries(spark, sf):
    """Pieces and their tokens by the kind of boundary at which they end."""
    return p7_pieces(spark, sf).groupBy("boundary").agg(F.count("*").alias("n_pieces"), F.sum("n_tokens").alias("n_tokens"))


def p7_cover(spark, sf):
    """Characters that the pieces of every text cover, and pieces that are too large or out of place."""
    after = F.lead("core_begin").over(W.partitionBy("doc_id").orderBy("piece"))
    first = F.row_number().over(W.partitionBy("doc_id").orderBy("piece")) == 1
    steps = p7_pieces(spark, sf).select(
        "doc_id", "begin", "core_begin", "until", "n_tokens", F.length("text").alias("held"), after.alias("after"), first.alias("first")
    )
    bad = (
        (F.col("n_tokens") > S.LIMIT) | (F.col("until") <= F.col("core_begin")) | (F.col("begin") > F.col("core_begin"))
        | (F.col("held") != F.col("until") - F.col("begin")) | (F.col("first") & (F.col("core_begin") != 0)) | (F.coalesce("after", "until") != F.col("until"))
    )
    cover = steps.groupBy("doc_id").agg(F.sum(F.col("until") - F.col("core_begin")).alias("covered"), F.count(F.when(bad, 1)).alias("n_bad"))
    docs = table(spark, sf, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.length("text").cast("long").alias("n_chars"))
    return docs.join(cover, "doc_id", "left").select("doc_id", F.coalesce("covered", "n_chars").alias("n_chars"), F.coalesce("n_bad", F.lit(0)).alias("n_bad"))


QUERIES = {f.__name__: f for f in (p5_packing, p5_fill, p5_whole, p7_pieces, p7_boundaries, p7_cover)}
# the invariants of results that SQL cannot make
SQL = {
    "p5_whole": """SELECT count(DISTINCT doc_id) AS n_items, CAST(0 AS BIGINT) AS n_torn, CAST(0 AS BIGINT) AS n_over, CAST(0 AS BIGINT) AS n_tight
FROM documents WHERE doc_id IS NOT NULL AND text <> ''""",
    "p7_cover": "SELECT doc_id, length(text) AS n_chars, CAST(0 AS BIGINT) AS n_bad FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL",
}
