"""Exact top-k search by inner product with multi-resolution segment statistics.

Vectors are turned into integers floor(256 x). Every vector keeps the mean and deviation of its
segments at several resolutions. For a segment of n components, the squared distance of two vectors
is at least n ((difference of means)^2 + (difference of deviations)^2), so the inner product
(|x|^2 + |y|^2 - d^2) / 2 is at most the sum of n (mean * mean + deviation * deviation). These bounds
are matrix products, taken coarse to fine; pairs whose bound falls below the query's k-th score so
far are dropped, and only survivors get an exact integer product.

The query set is stated by the caller. It is dealt into blocks of at most about ``broadcast_bytes`` by
its counted size; each block is broadcast and meets every candidate in one pass, in which a task keeps
its k best rows a query as floors for all that it still reads. Nothing but k rows a query and task is
shuffled, and one block at a time is in the driver.

Defined results:
* vectors that are null, empty, or hold null, NaN or infinite components take no part, as queries
  or as candidates; nor do rows with a null id.
* a query meets the vectors of its own length.
* ties go to the smaller vec_id; repeated rows are candidates each, but a query id is searched once,
  with its least vector if it has several, and never meets rows of its own id.
* fewer than k candidates: all of them. Other columns are ignored.
* scores are exact while they fit a long; components beyond a long count as its bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.session import stored

LEVELS = (1, 4, 16)
_OUT = "query_id long, vec_id long, score long"


def clean(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): integer vectors without the ones that take no part."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("x"))
        .filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0))
        .filter(~bad)
        .select("vec_id", F.transform("x", lambda c: F.floor(c * 256).cast("long")).alias("v"))
    )


def statistics(v: np.ndarray, segments: int) -> np.ndarray:
    """n x 2s: root-weighted means, then deviations, so that a dot product gives the bound."""
    cuts = np.unique(np.linspace(0, v.shape[1], min(segments, v.shape[1]) + 1).astype(int))
    sizes = np.diff(cuts)
    mean = np.add.reduceat(v, cuts[:-1], axis=1) / sizes
    square = np.add.reduceat(v * v, cuts[:-1], axis=1) / sizes
    deviation = np.sqrt(np.maximum(square - mean * mean, 0))
    return np.hstack([mean, deviation]) * np.sqrt(np.hstack([sizes, sizes]))


class Searcher:
    """Keeps the k best candidates of each query over any number of blocks."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, k: int):
        self.ids, self.whole, self.v, self.k = ids, v, v.astype(np.float64), k
        self.stats = [statistics(self.v, s) for s in LEVELS]
        self.length = np.sqrt((self.v * self.v).sum(axis=1))
        self.largest = np.abs(self.v).max(initial=0.0)
        self.multiplied = 0  # pairs that were not dropped by their bounds
        self.best_score = np.full((len(ids), k), np.iinfo(np.int64).min)
        self.best_id = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.found = np.zeros(len(ids), np.int64)  # candidates that came in
        self.kept = np.zeros(len(ids), np.int64)

    def add(self, ids: np.ndarray, whole: np.ndarray, block: int = 512) -> None:
        v = whole.astype(np.float64)
        stats = [statistics(v, s) for s in LEVELS]
        for i in range(0, len(ids), block):
            own = slice(i, i + block)
            self._block(ids[own], whole[own], v[own], [s[own] for s in stats])

    def _scores(self, q: np.ndarray, c: np.ndarray, whole: np.ndarray, v: np.ndarray, dense: bool) -> np.ndarray:
        # float64 holds these integers exactly while they stay under 2^53
        if self.largest * np.abs(v).max(initial=0.0) * v.shape[1] < 2.0**53:
            if dense:
                return (self.v @ v.T)[q, c].astype(np.int64)
            one, two = self.v, v
        else:
            one, two = self.whole, whole
        parts = [np.einsum("ij,ij->i", one[q[i : i + 65536]], two[c[i : i + 65536]]) for i in range(0, len(q), 65536)]
        return np.concatenate(parts).astype(np.int64)

    def _block(self, ids: np.ndarray, whole: np.ndarray, v: np.ndarray, stats: list[np.ndarray]) -> None:
        slack = 1e-6 + 1e-9 * self.length * np.sqrt((v * v).sum(axis=1).max(initial=0.0))
        floor = np.where(self.found < self.k, -np.inf, self.best_score[:, -1] - slack)
        q, c = None, None
        for own, other in zip(self.stats, stats, strict=True):
            if q is None:
                bound = own @ other.T
                q, c = np.nonzero(bound >= floor[:, None])
            elif len(q) > bound.size // 2:  # few were dropped: one product is cheaper than pairs
                keep = (own @ other.T)[q, c] >= floor[q]
                q, c = q[keep], c[keep]
            else:
                keep = np.einsum("ij,ij->i", own[q], other[c]) >= floor[q]
                q, c = q[keep], c[keep]
        other_row = ids[c] != self.ids[q]
        q, c = q[other_row], c[other_row]
        self.multiplied += len(q)
        if not len(q):
            return
        score = self._scores(q, c, whole, v, len(q) > bound.size // 4)
        better = (score >= self.best_score[q, -1]) | (self.found[q] < self.k)
        q, c, score = q[better], ids[c[better]], score[better]
        rows = np.unique(q)
        if not len(rows):
            return
        self.found += np.bincount(q, minlength=len(self.found))
        allq = np.concatenate([q, np.repeat(rows, self.k)])
        alls = np.concatenate([score, self.best_score[rows].ravel()])
        alli = np.concatenate([c, self.best_id[rows].ravel()])
        empty = np.concatenate([np.zeros(len(q), bool), (np.arange(self.k) >= self.kept[rows][:, None]).ravel()])
        order = np.lexsort((alli, ~alls, empty, allq))  # ~x falls as x grows, and cannot overflow
        allq, alls, alli = allq[order], alls[order], alli[order]
        first = np.searchsorted(allq, rows)
        pick = first[:, None] + np.arange(self.k)
        self.best_score[rows], self.best_id[rows] = alls[pick], alli[pick]
        self.kept = np.minimum(self.found, self.k)

    def rows(self) -> pa.RecordBatch:
        q, j = np.nonzero(np.arange(self.k) < self.kept[:, None])
        return pa.RecordBatch.from_arrays(
            [pa.array(self.ids[q]), pa.array(self.best_id[q, j]), pa.array(self.best_score[q, j])],
            names=["query_id", "vec_id", "score"],
        )


def by_length(ids: np.ndarray, column: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """length -> (ids, integer matrix), straight from the column's buffers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    size, out = np.diff(at), {}
    for n in np.unique(size).tolist():
        own = np.flatnonzero(size == n)
        out[n] = ids[own], flat[at[own][:, None] + np.arange(n)]
    return out


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    broadcast_bytes: int = 32 << 20,
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products.

    vectors, queries: (vec_id, v) as clean() gives them.
    """
    spark = vectors.sparkSession
    vectors = stored(vectors, "vectors")
    queries = stored(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    size = queries.agg(F.coalesce(F.sum(8 * (F.size("v") + 1)), F.lit(0))).first()[0]
    n_blocks = max(1, -(-size // broadcast_bytes))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks))
    found = None
    for i in range(n_blocks):
        own = queries.filter(block == i).toArrow()
        shared = spark.sparkContext.broadcast(by_length(own.column("vec_id").to_numpy(), own.column("v")))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            searchers: dict[int, list[Searcher]] = {}
            for b in batches:
                for n, (ids, v) in by_length(b.column("vec_id").to_numpy(), b.column("v")).items():
                    if n in shared.value:
                        if n not in searchers:  # few queries at a time bound the matrices
                            own = shared.value[n]
                            searchers[n] = [Searcher(own[0][i : i + 2048], own[1][i : i + 2048], k) for i in range(0, len(own[0]), 2048)]
                        for s in searchers[n]:
                            s.add(ids, v)
            for many in searchers.values():
                for s in many:
                    yield s.rows()

        best = vectors.select("vec_id", "v").mapInArrow(run, _OUT)
        if n_blocks > 1:
            best = stored(best, "top-k")
            shared.unpersist()
        found = best if found is None else found.unionAll(best)
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def top_k_report(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """Queries: rows whose vec_id is divisible by ``every``; candidates: every row but the query's own."""
    own = clean(vectors)
    return top_k(own, own.filter(F.col("vec_id") % every == 0), k)
