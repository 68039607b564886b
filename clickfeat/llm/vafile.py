"""Exact top-k search with vector-approximation files (Weber et al., 1998).

Every vector component is quantised to a cell ``CELL`` wide, held in a block's
approximation file; the block's exact vectors stand apart from it.  For a
query, the cells bound each inner product from both sides.  A block is scanned
once through its cells; then exact vectors are read in the order of their
upper bounds, until the k-th best exact score is above every bound left.

Vectors and queries are dealt into blocks of bounded size by a hash of their id;
each pair of a vector block and a query block is one task, and each yields k
rows a query, so nothing is gathered whole.  Scores are integers and exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

VECTORS, QUERIES = 16_384, 4096  # rows of a block, about
CELL = 16
SCAN = 256  # queries whose bounds are held at once


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.int64).reshape(len(column), -1)


def _inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``a`` with those of ``b``: in double
    precision where every sum stays below 2^53."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2 ** 53:
        return a.astype(np.float64) @ b.T.astype(np.float64)
    return (a.astype(object) @ b.T.astype(object)) if top >= 2 ** 63 else a @ b.T


def search_block(vec_ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int):
    """The k best ``(query_id, vec_id, score)`` of one block for each query."""
    if not len(vec_ids) or not len(query_ids):
        return
    cells = vectors // CELL  # the approximation file
    for lo in range(0, len(queries), SCAN):
        q, ids = queries[lo:lo + SCAN], query_ids[lo:lo + SCAN]
        bound = _inner(q, cells) * CELL
        high = bound + (np.maximum(q, 0).sum(axis=1) * (CELL - 1))[:, None]
        low = bound + (np.minimum(q, 0).sum(axis=1) * (CELL - 1))[:, None]
        for i, own in enumerate(ids):
            others = vec_ids != own
            if k < others.sum():
                sure = np.partition(low[i][others], -k)[-k]
                others &= high[i] >= sure
            at = np.flatnonzero(others)
            at = at[np.lexsort((vec_ids[at], -high[i][at].astype(np.float64)))]
            best = np.zeros((0,), np.int64)
            score = np.zeros((0,), np.int64)
            for a in range(0, len(at), 64):
                part = at[a:a + 64]
                if len(best) == k and high[i][part[0]] < score[-1]:
                    break  # equal bounds go on: a tie may have a smaller id
                score = np.concatenate([score, _inner(q[i:i + 1], vectors[part])[0].astype(np.int64)])
                best = np.concatenate([best, vec_ids[part]])
                top = np.lexsort((best, -score))[:k]
                best, score = best[top], score[top]
            for v, s in zip(best, score):
                yield int(own), int(v), int(s)


def _searched(k: int):
    def run(key, vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = list(search_block(vectors["vec_id"].to_numpy(), _matrix(vectors["v"]),
                                  queries["query_id"].to_numpy(), _matrix(queries["v"]), k))
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")
    return run


def usable(table: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """``id, dim, v``: floor(scale * x) of every vector without null or
    non-finite components; rows without an id are left out, and rows repeated
    with one id and vector count once."""
    x = F.transform(F.col(vector).cast("array<double>"), lambda e: e)
    fine = F.col(vector).isNotNull() & F.forall(x, lambda e: F.coalesce(F.abs(e) < float("inf"), F.lit(False)))
    return (table.where(F.col(key).isNotNull() & fine)
                 .select(F.col(key).cast("long").alias("id"), F.size(vector).alias("dim"),
                         F.transform(x, lambda e: F.floor(e * scale).cast("long")).alias("v"))
                 .where("dim > 0").dropDuplicates(["id", "v"]))


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``vectors`` and ``queries`` as ``usable`` gives them -> ``query_id, rank,
    vec_id, score``: each query's k largest inner products over the vectors of its
    dimension with another id, ties to the smaller id.

    A query without such vectors has no row, one with fewer has as many.  Ids
    with several different vectors count with each."""
    nv = 1 + vectors.count() // VECTORS
    nq = 1 + queries.count() // QUERIES
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    blocks = vectors.select(F.col("id").alias("vec_id"), "dim", "v", F.pmod(F.xxhash64("id"), F.lit(nv)).cast("int").alias("vb"),
                            every(nq).alias("qb"))
    asked = queries.select(F.col("id").alias("query_id"), "dim", "v", F.pmod(F.xxhash64("id"), F.lit(nq)).cast("int").alias("qb"),
                           every(nv).alias("vb"))
    keys = ["dim", "vb", "qb"]
    best = (blocks.groupBy(*keys).cogroup(asked.groupBy(*keys))
                  .applyInPandas(_searched(k), "query_id long, vec_id long, score long"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
                .select("query_id", "rank", "vec_id", "score"))
