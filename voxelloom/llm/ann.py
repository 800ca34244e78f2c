"""Approximate nearest neighbours by collision-counting hashing.

The index holds blocks of vectors; a block has one sorted array per random projection.  A query
opens a window around its own projection in each array and widens all windows by a constant
factor from round to round (virtual rehashing).  A vector that fell into enough windows is
verified with its true distance.  A query is done with a block when a vector as near as
its k-th best would have collided often enough with a high probability.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from voxelloom.llm.common import Work

K = 10
PROJECTIONS = 48
#: Share of the windows that a vector has to be in to be verified.
THRESHOLD = 0.55
#: Windows widen by this factor.
RATIO = 1.25
#: A neighbour at the k-th distance is met with at least this probability when a search ends.
SURE = 0.98
BLOCK_ROWS = 4096
QUERY_ROWS = 1024
SEED = 20250


def _normal(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def enough(share: float = THRESHOLD, m: int = PROJECTIONS, sure: float = SURE) -> float:
    """Half window over distance at which a vector collides in ``share * m`` windows with probability *sure*."""
    need = math.ceil(share * m)
    lo, hi = 0.0, 10.0
    for _ in range(60):
        mid = (lo + hi) / 2
        p = 2 * _normal(mid) - 1
        tail = sum(math.comb(m, i) * p ** i * (1 - p) ** (m - i) for i in range(need, m + 1))
        lo, hi = (lo, mid) if tail >= sure else (mid, hi)
    return hi


def search_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int = K, bound: np.ndarray | None = None):
    """For every query the *k* nearest found in one block: ``(query row, id, distance)`` arrays.

    A query whose k-th distance has a *bound* (else infinity) opens its windows for that distance at once; what is
    as near is met with the same probability as by widening, and what is farther is not wanted.
    """
    m, dim = PROJECTIONS, x.shape[1]
    a = np.random.default_rng(SEED).standard_normal((dim, m))
    px, pq = x @ a, (q @ a).T.copy()
    order = np.argsort(px, axis=0, kind="stable")
    px = np.take_along_axis(px, order, axis=0)
    need, reach = math.ceil(THRESHOLD * m), enough()
    spread = np.median(px[-1] - px[0]) if len(x) > 1 else 1.0
    step = max(float(spread) / 16, 1e-9)
    px, order = px.T.copy(), order.T.copy()
    known = np.isfinite(bound) if bound is not None else np.zeros(len(q), dtype=bool)
    half = np.full(len(q), step)
    if known.any():
        half[known] = np.maximum(reach * bound[known], 1e-9)
    lo = np.stack([np.searchsorted(px[i], pq[i]) for i in range(m)])
    hi = lo.copy()
    count = np.zeros((len(q), len(x)), dtype=np.int16)
    taken = ids[None, :] == query_ids[:, None]
    rows, dist = [np.zeros(0, dtype=np.int64)] * len(q), [np.zeros(0)] * len(q)
    active = np.arange(len(q))
    while len(active):
        # the windows of all queries are looked up projection by projection
        low = np.stack([np.searchsorted(px[i], pq[i, active] - half[active], side="left") for i in range(m)])
        high = np.stack([np.searchsorted(px[i], pq[i, active] + half[active], side="right") for i in range(m)])
        low, high = np.minimum(low, lo[:, active]), np.maximum(high, hi[:, active])
        more = []
        for at, j in enumerate(active.tolist()):
            ends = zip(low[:, at].tolist(), lo[:, j].tolist(), hi[:, j].tolist(), high[:, at].tolist())
            met = [part for i, (a_lo, b_lo, b_hi, a_hi) in enumerate(ends) for part in (order[i, a_lo:b_lo], order[i, b_hi:a_hi])]
            count[j] += np.bincount(np.concatenate(met), minlength=len(x)).astype(np.int16)
            new = np.flatnonzero((count[j] >= need) & ~taken[j])
            if len(new):
                taken[j, new] = True
                diff = x[new] - q[j]
                rows[j], dist[j] = np.concatenate([rows[j], new]), np.concatenate([dist[j], np.sqrt((diff * diff).sum(axis=1))])
            if known[j] or (len(rows[j]) >= k and half[j] >= reach * np.partition(dist[j], k - 1)[k - 1]):
                continue
            if taken[j].all() or (not (low[:, at] > 0).any() and not (high[:, at] < len(x)).any()):
                continue
            more.append(j)
        lo[:, active], hi[:, active] = low, high
        active = np.array(more, dtype=np.int64)
        half[active] *= RATIO
    found_q, found_id, found_d = [], [], []
    for j in range(len(q)):
        best = np.lexsort((ids[rows[j]], dist[j]))[:k]
        found_q.append(np.full(len(best), query_ids[j]))
        found_id.append(ids[rows[j][best]])
        found_d.append(dist[j][best])
    return np.concatenate(found_q), np.concatenate(found_id), np.concatenate(found_d)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, v, dim)``: one finite vector other than zero per id; of several of an id the least counts."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    return (rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)
            .groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id",
            vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the *k* nearest rows found for each query, its own id left out.

    ``score`` is the Euclidean distance in double precision; ties go to the smaller vec_id.  Every usable vector is
    indexed, in blocks dealt by a hash of the id, and every block meets every block of queries of the same
    dimension; the first block goes ahead and bounds the k-th distance for all others.  Null vectors, zero vectors and vectors with a null or non-finite component take no part;
    a query with fewer candidates than *k* gets them all; other columns are not read.
    """
    work = Work(vectors.sparkSession, "ann")
    base = work.put(usable(vectors, id_col, vector_col), "vectors")
    asked = work.put(usable(queries, id_col, vector_col), "queries")
    blocks = max(1, -(-base.count() // BLOCK_ROWS))
    groups = max(1, -(-asked.count() // QUERY_ROWS))
    data = base.withColumns({"block": F.pmod(F.xxhash64("vec_id"), F.lit(blocks)),
                             "part": F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))})
    ask = asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int"))
    keys = ["dim", "part", "block"]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        left, right = left.sort_values("vec_id"), right.sort_values("vec_id")
        q, i, d = search_block(left["vec_id"].to_numpy(), np.stack(left["v"].to_numpy()), right["vec_id"].to_numpy(),
                               np.stack(right["v"].to_numpy()), k, right["bound"].to_numpy(dtype=float, na_value=np.inf))
        return pd.DataFrame({"query_id": q, "vec_id": i, "score": d})

    def search(data: DataFrame, ask: DataFrame) -> DataFrame:
        return data.groupBy(*keys).cogroup(ask.groupBy(*keys)).applyInPandas(run, "query_id bigint, vec_id bigint, score double")

    one = ask.withColumns({"bound": F.lit(None).cast("double"), "block": F.lit(0).cast("bigint")})
    near = search(data.where("block = 0"), one)
    if blocks > 1:
        near = work.put(near, "first")
        bound = near.groupBy("query_id").agg(F.max("score").alias("bound"), F.count("*").alias("c")).where(F.col("c") >= k)
        ask = ask.join(bound.select(F.col("query_id").alias("vec_id"), "bound"), "vec_id", "left")
        rest = ask.withColumn("block", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
        near = near.unionByName(search(data.where("block > 0"), rest))
    best = F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k)  # k rows per block and query
    return (near.groupBy("query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("at", "b"))
            .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "b.vec_id", "b.score"))
