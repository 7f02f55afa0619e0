"""Ranked lexical search of many queries at once, and fusion of ranked lists.

Only the words that some query holds leave the scan: the distinct words of the
queries, whose number is checked, are broadcast and filter the exploded words
before the first shuffle.  Beyond that number the same join is shuffled.  The
best k of a query come from a ranked window, which Spark cuts to k rows in
every partition before the shuffle.

Defined cases: a null field has no words; a null id is dropped; repeated rows of
one id count once; a query without words, and an empty table, give no rows;
equal scores are ordered by id.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.text import words
from loomspark.session import cut

# Saturation and length of the ranking function
K1, B = 1.2, 0.75
BROADCAST_WORDS = 200_000


def query_words(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct ``(query_id, term)`` of the queries."""
    return queries.select(F.col(id_col).alias("query_id"), F.explode(F.array_distinct(words(F.col(text_col)))).alias("term"))


def _tagged(c: str) -> Column:
    return F.transform(F.col(c), lambda w: F.struct(w.alias("term"), F.lit(c).alias("field")))


def small(df: DataFrame, rows: int = BROADCAST_WORDS) -> DataFrame:
    """``df`` marked for broadcast if it has no more than ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def by_repetition(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``id`` stands alone, and the rows of repeated ids.

    Only ids are shuffled to tell them apart, and whole rows only where the
    repeated ids are too many to be broadcast.
    """
    again = small(cut(rows.groupBy("id").count().where("count > 1").select("id"), "repeated-ids"))
    return rows.join(again, "id", "left_anti"), rows.join(again, "id", "left_semi")


def postings(docs: DataFrame, id_col: str, columns: list[str], terms: DataFrame, unique: bool = False) -> DataFrame:
    """``(id, term, field, n, sizes)`` for the given terms, from one scan, in the shared folder.

    ``n`` counts the hits of a term in a field, ``sizes`` holds the words of
    every field.  Every row has one more entry with the empty term, which
    carries its sizes whether or not it holds any of the terms.  ``unique`` says
    that no id is repeated.
    """
    base = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), *columns)
    if not unique:
        single, several = by_repetition(base)
        base = single.unionByName(several.distinct())
    base = base.select("id", *[words(F.col(c)).alias(c) for c in columns])
    sizes = F.struct(*[F.size(c).alias(c) for c in columns])
    tagged = [_tagged(c) for c in columns]
    mark = F.array(F.struct(F.lit("").alias("term"), F.lit(columns[0]).alias("field")))
    seen = base.select("id", sizes.alias("sizes"), F.explode(F.concat(mark, *tagged)).alias("t"))
    terms = terms.unionByName(terms.sparkSession.range(1).select(F.lit("").alias("term")))
    held = seen.select("id", "sizes", "t.term", "t.field").join(small(terms), "term", "left_semi")
    return cut(held.groupBy("id", "sizes", "term", "field").agg(F.count("*").alias("n")), "lexical-hits")


def ranked(scored: DataFrame, k: int, tie: str = "id") -> DataFrame:
    """The best ``k`` of each query with their rank from 1."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(tie))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def score(found: DataFrame, weights: dict[str, float], terms: DataFrame, k: int) -> DataFrame:
    """``(query_id, id, score, rank)``: the best ``k`` rows of each query from the postings of the weighted fields.

    The weight of a word in n of N rows is ``ln((N - n + .5) / (n + .5))``, or
    1e-6 where that is not positive.
    """
    size = reduce(add, [F.col("sizes")[c] for c in weights])
    n_docs, avg_len = found.where("term = ''").agg(F.count("*"), F.avg(size)).first()
    avg_len = avg_len or 1.0
    weight = reduce(lambda w, c: w.when(F.col("field") == c, float(weights[c])), weights, F)
    held = found.where((F.col("term") != "") & F.col("field").isin(list(weights)))
    # all words of a document are in one task, where the queries meet it: pairs are added up before they travel
    hits = held.repartition("id").groupBy("id", "sizes", "term").agg(F.sum(weight * F.col("n")).alias("tf")).select("id", "term", "tf", size.alias("len"))
    # of a single field every row is a document of its own
    rare = (held if len(weights) == 1 else hits).groupBy("term").agg(F.count("*").alias("n"))
    raw = F.log((n_docs - F.col("n") + 0.5) / (F.col("n") + 0.5))
    idf = rare.select("term", F.when(raw > 0, raw).otherwise(F.lit(1e-6)).alias("idf"))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / avg_len))
    weighed = hits.join(small(idf), "term").select("id", "term", part.alias("part"))
    scored = weighed.join(small(terms), "term").groupBy("query_id", "id").agg(F.round(F.sum("part"), 6).alias("score"))
    return ranked(scored, k)


def bm25(docs: DataFrame, id_col: str, weights: dict[str, float], terms: DataFrame, k: int, unique: bool = False) -> DataFrame:
    """:func:`score` over postings made for one list alone; ``terms`` is what :func:`query_words` gives."""
    return score(postings(docs, id_col, list(weights), terms.select("term").distinct(), unique), weights, terms, k)


def fuse(lists: list[DataFrame], k: int, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of ``(query_id, id, rank)`` lists.

    The score of a row is the sum of ``1 / (constant + rank)`` over the lists
    that hold it.
    """
    votes = reduce(DataFrame.unionByName, [one.select("query_id", "id", (1.0 / (constant + F.col("rank"))).alias("vote")) for one in lists])
    return ranked(votes.groupBy("query_id", "id").agg(F.round(F.sum("vote"), 9).alias("score")), k)


def min_max(scored: DataFrame) -> DataFrame:
    """``score`` brought to 0..1 within each query; a constant set is 1 if positive, else 0."""
    span = Window.partitionBy("query_id")
    low, high = F.min("score").over(span), F.max("score").over(span)
    scaled = F.when(high > low, (F.col("score") - low) / (high - low)).otherwise((F.col("score") > 0).cast("double"))
    return scored.withColumn("scaled", F.round(scaled, 6))


def diversify(listed: DataFrame, group_col: str, head: int = 10, per_group: int = 3) -> DataFrame:
    """Moves rows back so that the first ``head`` hold at most ``per_group`` of a group.

    ``listed`` holds ``query_id`` and ``rank``; the new place is ``place``.
    """
    own = Window.partitionBy("query_id", group_col).orderBy("rank")
    first = Window.partitionBy("query_id", "fits").orderBy("rank")
    flagged = listed.withColumn("fits", F.row_number().over(own) <= per_group)
    flagged = flagged.withColumn("front", F.col("fits") & (F.row_number().over(first) <= head))
    order = Window.partitionBy("query_id").orderBy(F.col("front").desc(), "rank")
    return flagged.withColumn("place", F.row_number().over(order)).drop("fits", "front")
