"""Quality of ranked lists against expected items: recall, reciprocal rank, nDCG.

Defined cases: repeated expectations count once; a query without expectations
gives no row; one whose list holds none of them scores 0 throughout; null ids
match nothing; ranks are from 1 and a row's best rank holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quality(listed: DataFrame, expected: DataFrame, k: int = 10) -> DataFrame:
    """``(query_id, n_expected, recall, mrr, ndcg)`` of ``(query_id, id, rank)`` against ``(query_id, id)``.

    Recall and nDCG look at the first ``k``, the reciprocal rank at the whole list.
    """
    expected = expected.where("query_id IS NOT NULL AND id IS NOT NULL").select("query_id", "id").distinct()
    best = listed.groupBy("query_id", "id").agg(F.min("rank").alias("rank"))
    both = expected.join(best, ["query_id", "id"], "left")
    near = F.col("rank") <= k
    gain = F.when(near, 1.0 / F.log2(F.col("rank") + 1))
    rows = both.groupBy("query_id").agg(
        F.count("*").alias("n_expected"), F.count(F.when(near, 1)).alias("hits"), F.min("rank").alias("first"), F.coalesce(F.sum(gain), F.lit(0.0)).alias("dcg")
    )
    places = F.sequence(F.lit(1), F.least(F.col("n_expected"), F.lit(k)).cast("int"))
    ideal = F.aggregate(places, F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1))
    return rows.select(
        "query_id",
        "n_expected",
        F.round(F.col("hits") / F.col("n_expected"), 6).alias("recall"),
        F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.col("dcg") / ideal, 6).alias("ndcg"),
    )
