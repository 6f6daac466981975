"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

The index holds, for every shard of vectors, the places sorted by each dimension's value.  A query reads all its
lists from their better ends in step; every place met for the first time is scored in full; the products at the
present depth add up to a bound for all places not yet met, and reading stops as soon as the k-th best score is
above it.  A query goes from shard to shard with what it has found so far, so that later shards stop earlier, or at
depth 0; the best of every part of the shards are merged in the end.  The depth grows by doubling, so that each
step is one gather and one product.

Work grows with queries x vectors where values are spread evenly over many dimensions: a bound over 64 lists
falls below the k-th score only after most places have been met.  Few large components, or clusters, end it early.

Results for special cases: components are floor(factor * x) in double precision; vectors that are null, or hold
null or non-finite components, and rows without vec_id take no part; zero vectors do.  Vectors are compared with
those of their own dimension.  Rows that share a vec_id are each a query (with rows of the result of its own) and
each a candidate; only the query's own row is none.  Scores beyond 64 bits stop at its limits.  Ties go to the smaller vec_id;
fewer candidates than k give fewer rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from restora.llm import shards as S

#: Places read from every list in the first step.
FIRST = 16


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of x with q."""
    if x.shape[1] * float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) < S.EXACT:
        return (x @ q).astype(np.int64)
    whole = np.array([int(c) for c in q], dtype=object)
    return np.array([min(max(int(sum(int(a) * b for a, b in zip(row, whole, strict=True))), -S.LONGEST), S.LONGEST) for row in x], dtype=np.int64)


class Best:
    """The k best so far: larger scores first, then smaller ids."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def full(self) -> bool:
        return len(self.scores) == self.k

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        if self.full():
            take = scores >= self.scores[-1]
            ids, scores = ids[take], scores[take]
        if not len(ids):
            return
        ids, scores = np.r_[self.ids, ids], np.r_[self.scores, scores]
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[order], scores[order]


def threshold_search(q: np.ndarray, x: np.ndarray, ids: np.ndarray, lists: np.ndarray, best: Best, own: int | None = None) -> int:
    """Adds to best what the vectors x hold; lists[d] are the places in ascending order of x[:, d].  Returns how many were scored."""
    n = len(x)
    up, down = np.flatnonzero(q < 0), np.flatnonzero(q > 0)
    met, scored = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    if own is not None:
        scored[own] = True
    depth, step = 0, FIRST
    while True:
        at_up, at_down = (lists[up, depth], lists[down, n - 1 - depth]) if depth < n else (up[:0], down[:0])
        if best.full() and depth < n:
            low, high = q[up] * x[at_up, up], q[down] * x[at_down, down]
            slack = 1e-9 * (np.abs(low).sum() + np.abs(high).sum())
            if float(best.scores[-1]) > low.sum() + high.sum() + slack:
                break
        to = min(n, depth + step)
        met[lists[up, depth:to].reshape(-1)] = True
        met[lists[down, n - to : n - depth].reshape(-1)] = True
        if to == n:
            met[:] = True  # also without any list, for a query of zeros
        new = np.flatnonzero(met & ~scored)
        scored[new] = True
        best.add(ids[new], exact(x[new], q))
        depth, step = to, 2 * step
        if depth == n:
            break
    return int(scored.sum()) - (own is not None)


def _meet(k: int):
    def meet(block: dict, shards: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        names, shard_of, place = (S.longs(block[n]) for n in ("q_ids", "q_shard", "q_place"))
        q = S.unpacked(block["q_at"], len(names), block["q_dim"])
        best, scored = [Best(k) for _ in names], np.zeros(len(names), np.int64)
        for s in shards:
            ids = S.longs(s["ids"])
            x, lists = S.unpacked(s["at"], len(ids), s["dim"]), np.frombuffer(s["lists"], dtype="<u2").reshape(s["dim"], len(ids))
            for i in range(len(names)):
                scored[i] += threshold_search(q[i], x, ids, lists, best[i], int(place[i]) if shard_of[i] == s["shard"] else None)
        size = [len(b.ids) for b in best]
        columns = [np.repeat(a, size) for a in (shard_of, place, names)] + [np.concatenate([b.ids for b in best]), np.concatenate([b.scores for b in best]), np.repeat(scored, size)]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["q_shard", "q_place", "query_id", "vec_id", "score", "scored"])

    return meet


def top_k(vectors: DataFrame, asked: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score of the k best of every row of vectors (vec_id, embedding) for which `asked` holds; n_scored is the number of vectors scored for them in the same part."""
    index = S.index(S.usable(vectors, asked), sorted_lists=True)
    found = S.against_all(S.blocks(index), index, _meet(k), "q_shard long, q_place long, query_id long, vec_id long, score long, scored long", ("lists",))
    rank = F.row_number().over(Window.partitionBy("q_shard", "q_place").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", F.col("scored").alias("n_scored"))


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 largest integer inner products of every fiftieth vector."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % 50 == 0, 5).drop("n_scored")
