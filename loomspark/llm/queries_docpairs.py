"""Queries that pair functions with their documentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.llm import docpairs as D
from loomspark.sources.tables import table


def p1_found(spark, sf):
    """Functions with real documentation, by the id of their first part."""
    return D.documented(table(spark, sf, "chunks")).select("id")


def p1_pairs(spark, sf):
    """Code and description of every documented function."""
    return D.pairs(table(spark, sf, "chunks"), table(spark, sf, "symbols"))


def p1_scope(spark, sf):
    """Functions there are, and pairs that are repeated or name none of them."""
    functions = D.first_parts(table(spark, sf, "chunks")).select("id").distinct()
    pairs = p1_pairs(spark, sf).groupBy("id").agg(F.count("*").alias("k"), F.min(F.length("description")).alias("d"), F.min(F.length("code")).alias("c"))
    both = functions.withColumn("known", F.lit(1)).join(pairs, "id", "full_outer")
    return both.agg(
        F.count("known").alias("n_functions"),
        F.count(F.when(F.col("known").isNull(), 1)).alias("n_outside"),
        F.count(F.when(F.col("k") > 1, 1)).alias("n_repeated"),
        F.count(F.when((F.col("d") < 1) | (F.col("c") < 1), 1)).alias("n_empty"),
    )


QUERIES = {"p1_found": p1_found, "p1_pairs": p1_pairs, "p1_scope": p1_scope}
# the invariants of a result that SQL cannot make
SQL = {
    "p1_scope": r"""SELECT count(DISTINCT id) AS n_functions, CAST(0 AS BIGINT) AS n_outside, CAST(0 AS BIGINT) AS n_repeated, CAST(0 AS BIGINT) AS n_empty
FROM chunks WHERE id IS NOT NULL AND content IS NOT NULL AND filepath IS NOT NULL AND chunk_type = 'code' AND name LIKE 'def %'
  AND regexp_extract(name, '\(part (\d+)/\d+\)\s*$', 1) IN ('', '1')""",
}
