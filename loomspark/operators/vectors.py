"""Exact nearest neighbours of a stated query set, in blocks.

Rows and queries are packed into matrices of at most ``block`` vectors of equal
length, in the tasks, and every pair of matrices is multiplied once.  Up to
``BROADCAST_BLOCKS`` blocks of queries are broadcast; more are sent to ``SALTS``
shares of the rows.  A pair yields at most the best k of each query (with ties
at the border), so what is shuffled after it is small beside the scan.

Defined cases: null ids, null vectors and vectors of another length than the
query's are dropped; a zero vector has distance 1 to all; equal distances (at
six digits) are ordered by id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.session import cut

BLOCK = 2048
BROADCAST_BLOCKS = 32
SALTS = 64
_HIT = "query_id long, id long, distance double"


def norm(v: Column) -> Column:
    """Euclidean length of an array of numbers."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """The vector at length one; null where it is null or all zero."""
    long = norm(v)
    return F.when(long > 0, F.transform(v, lambda x: x.cast("double") / long))


_PACKED = "dim int, ids binary, rows binary"


def _packed(size: int):
    """Vectors of equal length as matrices of at most ``size`` rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            long = pdf["v"].map(len)
            for dim, some in pdf[long > 0].groupby(long[long > 0]):
                for at in range(0, len(some), size):
                    part = some.iloc[at : at + size]
                    m = np.stack(part["v"].to_numpy()).astype(np.float64)
                    norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
                    unit = np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)
                    yield pd.DataFrame({"dim": [dim], "ids": [part["id"].to_numpy(np.int64).tobytes()], "rows": [unit.tobytes()]})

    return run


def _near(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, ids, rows, q_ids, q_rows in zip(pdf["dim"], pdf["ids"], pdf["rows"], pdf["q_ids"], pdf["q_rows"]):
                base, asked = np.frombuffer(rows).reshape(-1, dim), np.frombuffer(q_rows).reshape(-1, dim)
                far = np.round(1.0 - asked @ base.T, 6) + 0.0
                last = np.partition(far, min(k, far.shape[1]) - 1, axis=1)[:, min(k, far.shape[1]) - 1]
                q, r = np.nonzero(far <= last[:, None])
                yield pd.DataFrame({"query_id": np.frombuffer(q_ids, np.int64)[q], "id": np.frombuffer(ids, np.int64)[r], "distance": far[q, r]})

    return run


def nearest(base: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """``(query_id, id, distance, rank)``: the k rows of least cosine distance to each query."""
    whole = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()
    pick = [F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")]
    rows = base.where(whole).select(*pick).mapInPandas(_packed(block), _PACKED)
    asked = queries.where(whole).select(*pick)
    # about a block of queries in each partition, so that blocks are full
    asked = asked.repartition(max(1, -(-asked.count() // block)), "id").mapInPandas(_packed(block), _PACKED)
    asked = cut(asked.select("dim", F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows")), "vector-queries")
    if asked.limit(BROADCAST_BLOCKS + 1).count() <= BROADCAST_BLOCKS:
        pairs = rows.join(F.broadcast(asked), "dim")
    else:  # every block of queries goes to each of SALTS shares of the rows
        salt = F.pmod(F.xxhash64("ids"), F.lit(SALTS)).cast("int")
        pairs = rows.withColumn("salt", salt).join(asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["dim", "salt"]).drop("salt")
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    found = pairs.select("dim", "ids", "rows", "q_ids", "q_rows").mapInPandas(_near(k), _HIT)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
