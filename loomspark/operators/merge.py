"""Writes to the store as joins of what is stored with what is new.

Defined cases: null keys match nothing and are dropped; repeated keys of a new
side must have been made unique by the caller; empty sides keep or take all of
the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.session import cut


def upsert(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows of ``new``, and those of ``stored`` whose key it lacks."""
    new = new.where(F.col(key).isNotNull())
    return stored.join(new.select(key), key, "left_anti").select(*new.columns).unionByName(new)


def cascade(tables: dict[str, DataFrame], gone: DataFrame, key: str = "filepath") -> dict[str, DataFrame]:
    """Every table without the rows of the keys that are gone."""
    gone = gone.select(key).where(F.col(key).isNotNull()).distinct()
    return {name: df.join(gone, key, "left_anti") for name, df in tables.items()}


def with_ids(rows: DataFrame, after: int) -> DataFrame:
    """``rows`` with dense ids above ``after``, in the order of file and ordinal within shares of the files.

    Shares follow a hash of the path; their sizes, 4,096 figures, give each share
    its first id, so that no task orders all rows.
    """
    rows = rows.withColumn("share", F.substring(F.sha2("filepath", 256), 1, 3))
    sizes = rows.groupBy("share").agg(F.count("*").alias("n"))
    first = sizes.select("share", (F.sum("n").over(Window.orderBy("share")) - F.col("n") + after).alias("first"))
    place = F.row_number().over(Window.partitionBy("share").orderBy("filepath", "ordinal"))
    return rows.join(F.broadcast(first), "share").withColumn("id", F.col("first") + place).drop("share", "first")


def merge_chunks(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks after a merge that keeps ids: ``filepath, ordinal, id, parent_id, action``.

    ``stored`` holds ``(id, filepath, content_hash, name)``, ``new`` ``(filepath,
    ordinal, content_hash, name, parent)``, where ``parent`` is the ordinal of
    the parent in its file.  The k-th new chunk of a file with equal hash and
    name takes the id of the k-th stored one; what finds none is inserted, and
    stored chunks that are left are deleted (with null ordinal and parent).
    """
    same = ["filepath", "content_hash", "name"]
    turn = lambda order: F.row_number().over(Window.partitionBy(*same).orderBy(order))
    old = stored.select("id", *same).withColumn("k", turn("id"))
    both = new.withColumn("k", turn("ordinal")).join(old, [*same, "k"], "full_outer")
    both = cut(both.select("filepath", "ordinal", "parent", "id"), "merge-chunks")
    last = stored.agg(F.max("id")).first()[0] or 0
    fresh = with_ids(both.where("id IS NULL").drop("id"), last).withColumn("action", F.lit("inserted"))
    kept = both.where("id IS NOT NULL").withColumn("action", F.when(F.col("ordinal").isNull(), "deleted").otherwise("kept"))
    merged = cut(kept.unionByName(fresh.select(*kept.columns)), "merge-ids")
    heads = merged.where("ordinal IS NOT NULL").select("filepath", F.col("ordinal").alias("parent"), F.col("id").alias("parent_id"))
    return merged.join(heads, ["filepath", "parent"], "left").select("filepath", "ordinal", "id", "parent_id", "action")
