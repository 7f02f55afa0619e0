"""Queries that find evaluation passages in the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.llm import leakage as L
from loomspark.sources.tables import table


def _leaks(spark, sf):
    return L.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p6_found(spark, sf):
    """Every document with the items that it gives away."""
    return _leaks(spark, sf).select("doc_id", "item_id")


def p6_items(spark, sf):
    """Each leaked item with its number of documents and longest stretch."""
    return _leaks(spark, sf).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("words").alias("longest"))


def p6_verbatim(spark, sf):
    """Of the found pairs, those whose text holds every letter and digit of the passage in one piece."""
    flat = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    docs = table(spark, sf, "documents").select("doc_id", flat("text").alias("t"))
    items = table(spark, sf, "eval_items").select("item_id", flat("passage").alias("p"))
    return p6_found(spark, sf).join(docs, "doc_id").join(items, "item_id").where((F.length("p") > 0) & F.contains("t", "p")).select("doc_id", "item_id")


QUERIES = {"p6_found": p6_found, "p6_items": p6_items, "p6_verbatim": p6_verbatim}
# a pair that SQL can tell must be among those found
SQL = {
    "p6_verbatim": """WITH t AS (SELECT DISTINCT doc_id, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS t FROM documents WHERE text IS NOT NULL),
p AS (SELECT DISTINCT item_id, regexp_replace(lower(passage), '[^a-z0-9]+', '', 'g') AS p FROM eval_items WHERE passage IS NOT NULL)
SELECT doc_id, item_id FROM t, p WHERE p <> '' AND contains(t, p)""",
}
