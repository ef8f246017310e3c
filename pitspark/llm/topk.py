"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Candidates and queries are dealt into blocks by a hash of their ids, so no block grows with the data and copies of one
vector are spread. In each pair of blocks every dimension has a list of candidates sorted by that component. A query
reads the lists from the side that its own component favours, scores each newly seen candidate in full, and stops once
the best score that an unseen candidate could have is below its kth score. The blocks' winners meet in one window.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

EXACT = float(1 << 53)


def threshold_search(ids: np.ndarray, vectors: np.ndarray, order: np.ndarray, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best candidates (ties to the smaller id), the query's own id left out.

    ``order[:, d]`` lists the candidates by ascending component d.
    """
    n = len(ids)
    dims = np.flatnonzero(query)
    weight = query[dims]
    lists = order[:, dims]
    lists = np.where(weight > 0, lists[::-1], lists)
    seen = np.zeros(n, bool)
    best = np.empty(0, np.int64)
    scores = np.empty(0, vectors.dtype)
    depth, step = 0, max(4 * k, 32)
    while depth < n and len(dims):
        reach = min(n, depth + step)
        fresh = np.zeros(n, bool)
        fresh[lists[depth:reach].ravel()] = True
        fresh &= ~seen
        seen |= fresh
        new = np.flatnonzero(fresh)
        new = new[ids[new] != query_id]
        pool = np.concatenate([best, new])
        value = np.concatenate([scores, vectors[new] @ query])
        keep = np.lexsort((ids[pool], -value))[:k]
        best, scores = pool[keep], value[keep]
        bound = vectors[lists[reach - 1], dims] @ weight
        depth, step = reach, step * 2
        if len(best) == k and scores[-1] > bound:
            return ids[best], scores
    if not seen.all():  # a zero query: every score is 0
        new = np.flatnonzero(~seen & (ids != query_id))
        pool, value = np.concatenate([best, new]), np.concatenate([scores, vectors[new] @ query])
        keep = np.lexsort((ids[pool], -value))[:k]
        best, scores = pool[keep], value[keep]
    return ids[best], scores


def _matrix(rows: pd.Series) -> np.ndarray:
    """Integer vectors as rows; shorter ones end in zeros."""
    width = max((len(r) for r in rows), default=0)
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 5, candidate_block: int = 8192, query_block: int = 1024) -> DataFrame:
    """The k candidates with the highest inner product for each query, ties to the smaller id.

    Both inputs: ``vec_id`` (long) and ``q`` (array of long). Rows with a null id or a null or empty vector take no part; a
    candidate with the query's id is its own row. Vectors of different lengths count as padded with zeros. Repeated
    candidate rows each take a rank; repeated queries are answered once. Scores are exact while they fit a long.
    Result: ``query_id, rank`` (from 1), ``vec_id, score``.
    """
    c = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "q").where("vec_id IS NOT NULL AND size(q) > 0")
    q = queries.select(F.col("vec_id").cast("long").alias("vec_id"), "q").where("vec_id IS NOT NULL AND size(q) > 0").dropDuplicates(["vec_id"])
    nc, nq = max(1, math.ceil(c.count() / candidate_block)), max(1, math.ceil(q.count() / query_block))
    salt = F.xxhash64("vec_id")
    c = c.withColumn("cb", F.pmod(salt, F.lit(nc)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    q = q.withColumn("qb", F.pmod(salt, F.lit(nq)).cast("int")).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(nc - 1))))

    def search(cands: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(cands) and len(asks):
            both = _matrix(pd.concat([cands["q"], asks["q"]]))
            largest = float(np.abs(both).max())
            if largest * largest * both.shape[1] < EXACT:
                both = both.astype(np.float64)  # exact, and the faster product
            ids, v, w = cands["vec_id"].to_numpy(np.int64), both[:len(cands)], both[len(cands):]
            order = np.argsort(v, axis=0, kind="stable").astype(np.int32)
            for ask, query in zip(asks["vec_id"].to_numpy(np.int64), w):
                found, scores = threshold_search(ids, v, order, ask, query, k)
                out.append(pd.DataFrame({"query_id": ask, "vec_id": found, "score": scores.astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    found = c.groupBy("cb", "qb").cogroup(q.groupBy("cb", "qb")).applyInPandas(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id, q`` with q = floor(scale * component); vectors that are null or hold null or non-finite components are left out."""
    def usable(x):
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    e = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    e = e.where(F.col("e").isNotNull()).where(F.forall("e", usable))
    return e.select("vec_id", F.transform("e", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("q"))
