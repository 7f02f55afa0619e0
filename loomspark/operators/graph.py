"""The call graph of code chunks: references, centrality, definitions, reach.

Defined cases: null names are no nodes; repeated edges count once in ``reach``
and with their number in ``centrality``; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.session import cut

CALL = r"([A-Za-z_][A-Za-z0-9_]*)\("


def call_refs(chunks: DataFrame, definitions: DataFrame) -> DataFrame:
    """``(caller_id, caller, callee, project, n)``: calls of names that are defined somewhere.

    A chunk's own name, which stands in its signature, is no call.  Repeated
    rows of a chunk count once.  Calls are counted inside their row, so the
    join sees one row per chunk and callee.
    """
    code = chunks.where((F.col("chunk_type") == "code") & F.col("symbol_name").isNotNull())
    # the names are taken out before anything is shuffled
    code = code.select("id", "symbol_name", "project", F.regexp_extract_all("content", F.lit(CALL), 1).alias("names"))
    code = code.groupBy("id").agg(F.max(F.struct("symbol_name", "project", "names")).alias("c")).select("id", "c.*")
    called = code.select("id", F.col("symbol_name").alias("caller"), "project", F.explode("names").alias("callee"))
    called = called.where(F.col("callee") != F.col("caller")).groupBy("id", "caller", "project", "callee").agg(F.count("*").alias("n"))
    known = definitions.where(F.col("name").isNotNull()).select(F.col("name").alias("callee")).distinct()
    return called.join(known, "callee", "left_semi").select(F.col("id").alias("caller_id"), "caller", "callee", "project", "n")


def centrality(refs: DataFrame) -> DataFrame:
    """``(project, callee, n_refs, score)`` with ``ln(1 + n) / ln(1 + greatest n of the project)``."""
    n = refs.groupBy("project", "callee").agg(F.sum("n").alias("n_refs"))
    top = n.groupBy(F.col("project").alias("of")).agg(F.max("n_refs").alias("most"))
    both = n.join(top, F.col("project").eqNullSafe(F.col("of")))
    return both.select("project", "callee", "n_refs", F.round(F.log1p("n_refs") / F.log1p("most"), 6).alias("score"))


def first_per_key(rows: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key with their ``place`` from 1."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= k)


def reach(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """``(name, distance)`` of all names within ``depth`` links of a seed.

    ``edges`` holds ``(source, target)``.  Each round joins the new names to the
    edges and drops what was seen; the rounds are written to the shared folder.
    """
    edges = cut(edges.where("source IS NOT NULL AND target IS NOT NULL").select("source", "target").distinct(), "graph-edges")
    seen = cut(seeds.select("name").where("name IS NOT NULL").distinct().withColumn("distance", F.lit(0)), "graph-reach")
    fresh = seen
    for step in range(1, depth + 1):
        ahead = fresh.join(edges, fresh["name"] == edges["source"]).select(F.col("target").alias("name")).distinct()
        fresh = cut(ahead.join(seen.select("name"), "name", "left_anti").withColumn("distance", F.lit(step)), "graph-reach")
        seen = seen.unionByName(fresh)
    return seen
