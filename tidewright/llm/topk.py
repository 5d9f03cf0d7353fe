"""Exact top-k search by inner product with the threshold algorithm over sorted per-dimension lists.

Vectors are dealt into blocks by a hash of their id; each block of vectors meets each block of queries once (an equi-join on the pair of blocks, by
cogrouping). In a block, each dimension has its list sorted by component. A query walks all lists at once, from the top where its component is
positive and from the bottom where it is negative, in steps of DEPTH entries; vectors seen for the first time are scored in full. It stops when the sum of
what the lists can still give is below the k-th score found, or nothing is left to see. A last step merges the k best of each block.

Components x are quantised to floor(256 * x), so scores are integers and ties are exact; they go to the smaller vec_id.

Defined cases: vectors that are null, or hold null or non-finite components, take no part, nor does a null vec_id. Vectors of another length than the
query's are no candidates of it. Rows that repeat a vec_id with another vector are candidates each; a query's own vec_id never is. Equal rows count once. A component of 2**54 or more, and a score that is no long, raise an error.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import table

SCALE, TOP, EVERY = 256, 5, 50
LARGEST = float(2**62)  # bounds 256 * x, so that it and its negative are longs
VECTORS, QUERIES, DEPTH = 16_384, 2_048, 64  # rows of a block of vectors and of queries, entries of a list at a step


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, dims, q: array<long>) of the vectors that take part, each once."""
    e = F.col("embedding")
    fine = e.isNotNull() & F.col("vec_id").isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    scaled = lambda x: F.lit(float(SCALE)) * x.cast("double")
    whole = lambda x: F.when(F.abs(scaled(x)) < LARGEST, F.floor(scaled(x)).cast("long")).otherwise(F.raise_error(F.lit("a component is too large to be quantised")))
    return vectors.where(fine).select(F.col("vec_id").cast("long"), F.size(e).alias("dims"), F.transform(e, whole).alias("q")).distinct()


class Block:
    """Sorted lists over the rows of one block."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        at = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[at], rows[at]
        self.order = np.argsort(self.rows, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.rows, self.order, 0)
        self.peak = float(np.abs(self.rows).max(initial=0))
        self.exact = self.peak < 2**53
        self.floats = self.rows.astype(float)

    def scores(self, at: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Inner products; in floating point where that is exact, which is faster."""
        if self.exact and len(query) * self.peak * float(np.abs(query).max(initial=0)) < 2**53:
            return (self.floats[at] @ query.astype(float)).astype(np.int64)
        if not self.wide(query):
            return self.rows[at] @ query
        wide = self.rows[at].astype(object) @ query.astype(object)
        if any(abs(score) >= 2**63 for score in wide):
            raise ValueError("a score is no long")
        return wide.astype(np.int64)

    def wide(self, query: np.ndarray) -> bool:
        """Whether a sum of products could leave the range of a long."""
        return len(query) * self.peak * float(np.abs(query).max(initial=0)) >= 2**62

    def best(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids and scores of the k best rows other than the query's own."""
        n = len(self.ids)
        live, wide = np.flatnonzero(query), self.wide(query)
        up = query[live] > 0
        seen = self.ids == query_id
        left = n - int(seen.sum())
        found = np.zeros(0, np.int64)
        scores = np.zeros(0, np.int64)
        for depth in range(0, n, DEPTH):
            if not len(live):
                break
            some = np.arange(depth, min(depth + DEPTH, n))
            place = np.where(up[:, None], n - 1 - some[None, :], some[None, :])
            fresh = np.zeros(n, bool)
            fresh[self.order[place, live[:, None]]] = True
            fresh &= ~seen
            new = np.flatnonzero(fresh)
            seen |= fresh
            left -= len(new)
            found, scores = np.concatenate([found, new]), np.concatenate([scores, self.scores(new, query)])
            if len(found) > k:
                keep = np.lexsort((self.ids[found], -scores))[:k]
                found, scores = found[keep], scores[keep]
            last = self.sorted[place[:, -1], live]
            bound = sum(a * b for a, b in zip(last.tolist(), query[live].tolist(), strict=True)) if wide else int((last * query[live]).sum())
            if not left or len(found) == k and bound < scores.min():
                break
        if not len(live):  # all scores are 0
            found = np.flatnonzero(~seen)[:k]
            scores = np.zeros(len(found), np.int64)
        return self.ids[found], scores


def nearest(vectors: DataFrame, k: int = TOP, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id and score: the k best for each vector whose id is divisible by every, against all others."""
    rows = table(quantised(vectors), "quantised")
    is_query = F.col("vec_id") % every == 0
    n, n_queries = rows.agg(F.count("*"), F.count_if(is_query)).first()
    deal = lambda blocks, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(blocks)).cast("int")
    v_blocks, q_blocks = max(1, math.ceil(n / VECTORS)), max(1, math.ceil(n_queries / QUERIES))
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = rows.select("vec_id", "dims", "q", deal(v_blocks, 1).alias("vb")).select("vec_id", "dims", "q", "vb", each(q_blocks).alias("qb"))
    right = rows.where(is_query).select("vec_id", "dims", "q", deal(q_blocks, 2).alias("qb")).select("vec_id", "dims", "q", "qb", each(v_blocks).alias("vb"))

    def search(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        for dims in set(queries.column("dims").to_pylist()):
            ids, block = _matrix(vectors, dims)
            asked, questions = _matrix(queries, dims)
            if not len(ids):
                continue
            lists = Block(ids, block)
            for query_id, query in zip(asked.tolist(), questions, strict=True):
                found, scores = lists.best(query_id, query, k)
                out += [(query_id, v, s) for v, s in zip(found.tolist(), scores.tolist(), strict=True)]
        a, b, c = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.int64())})

    pairs = left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInArrow(search, "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = pairs.distinct().withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}")
    return ranked.select("query_id", "rank", "vec_id", "score")


def _matrix(t: pa.Table, dims: int) -> tuple[np.ndarray, np.ndarray]:
    t = t.filter(pa.compute.equal(t.column("dims"), dims))
    if not t.num_rows:
        return np.zeros(0, np.int64), np.zeros((0, dims), np.int64)
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t.column("q").chunks])
    return t.column("vec_id").to_numpy(), flat.astype(np.int64).reshape(-1, dims)


