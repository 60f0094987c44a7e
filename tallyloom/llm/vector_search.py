"""Exact top-k inner-product search by pivot-table elimination.

For integer vectors q.c = (|q|^2 + |c|^2 - d(q, c)^2) / 2.  By the triangle inequality d(q, c) is at least the
largest |d(q, p) - d(c, p)| over the pivots p, which bounds the score from above.

The distances of every vector to all pivots are a table: they are taken once, and written beside the vector.  A task bounds each of its candidates for each query by the largest
gap in that table, evaluates a query's candidates in the order of their bounds, and stops as soon as the next bound
is below the query's k-th score so far; equal bounds are still evaluated, so ties are exact.  Distances are taken of whole numbers and rounded once, and bounds are
widened by more than that rounding, at every size of the values.

Queries are a stated set of rows and are sent to the executors in blocks of a fixed
size, a job for each; each block meets each candidate once, and each task hands on at most k rows
a query.  The pivots are the only thing fitted, far apart from each other, on a bounded, stated sample; being candidates themselves, their k-th best score is
where every task's search of a query begins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.llm.common import new_path, settle

#: Candidates of a task that are searched at once, and queries that are bounded with them.
ROWS, QUERIES = 4096, 256
#: Candidates of a query that are evaluated first; then four times as many each time.
FIRST = 64
#: Vectors that pivots are chosen from.
SAMPLE = 1024
#: Room for rounding, as a share of what is rounded: several times what double precision needs, and single precision, in which gaps are taken.
SLACK, GAP_SLACK = 1e-12, 1e-6
#: The score of no candidate.
NONE = np.iinfo(np.int64).min + 1


def valid(vector: Column) -> Column:
    """Whether a vector takes part: neither null nor with a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def quantised(df: DataFrame, is_query: Column, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, asked, v): floor(scale * x) of every valid vector, and whether it is a query."""
    own = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("asked"), own.alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & valid(F.col("v"))).withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("long")))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors as rows, shorter ones filled with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dims), np.int64)
    out[np.arange(dims)[None, :] < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All products of the rows of two matrices, exact for doubles that hold whole numbers whose sums stay below 2^53."""
    return a @ b.T


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * dot(a, b), 0).astype(np.float64))


@dataclass
class Queries:
    """A block of queries in order of their ids, and the pivots; *exact*: whether doubles hold all sums."""

    ids: np.ndarray
    vectors: np.ndarray
    pivots: np.ndarray
    pivot_ids: np.ndarray
    exact: bool
    k: int

    def __post_init__(self) -> None:
        kind = np.float64 if self.exact else np.int64
        self.near = distances(self.vectors, self.pivots)
        self.vectors, self.pivots = self.vectors.astype(kind), self.pivots.astype(kind)
        self.norms = (self.vectors * self.vectors).sum(1)
        # The k-th best pivot, without the query itself, is no better than the k-th best candidate.
        scores = dot(self.vectors, self.pivots).astype(np.int64)
        scores[self.ids[:, None] == self.pivot_ids[None, :]] = NONE
        self.floor = np.partition(scores, -self.k, axis=1)[:, -self.k] if scores.shape[1] >= self.k else np.full(len(self.ids), NONE)


class Best:
    """The best k (score, id) of every query so far, best first."""

    def __init__(self, queries: Queries) -> None:
        self.queries, self.k = queries, queries.k
        self.score = np.full((len(queries.ids), self.k), NONE)
        self.id = np.full((len(queries.ids), self.k), np.iinfo(np.int64).max)

    def least(self, q: np.ndarray) -> np.ndarray:
        """What a score must reach to count."""
        return np.maximum(self.score[q, -1], self.queries.floor[q])

    def take(self, q: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Take in a row of scores for each of the queries *q*, by the candidates *ids*."""
        least = np.maximum(self.least(q), NONE + 1)
        hit = scores >= least[:, None]
        n = np.count_nonzero(hit)
        if not n:
            return
        if n > 4 * self.k * len(q) and scores.shape[1] > self.k:
            hit &= scores >= np.partition(scores, -self.k, axis=1)[:, -self.k, None]
        row, column = np.nonzero(hit)
        met, at = np.unique(row, return_inverse=True)
        own = q[met]
        owner = np.concatenate((at, np.repeat(np.arange(len(met)), self.k)))
        all_score, all_id = np.concatenate((scores[row, column], self.score[own].ravel())), np.concatenate((ids[column], self.id[own].ravel()))
        order = np.lexsort((all_id, -all_score, owner))
        first = np.searchsorted(owner[order], np.arange(len(met)))
        best = order[first[:, None] + np.arange(self.k)]
        self.score[own], self.id[own] = all_score[best], all_id[best]


def search(queries: Queries, best: Best, ids: np.ndarray, rows: np.ndarray, near: np.ndarray) -> int:
    """Hold a chunk of candidates, with their distances to the pivots, against all queries; gives how many products were taken."""
    rows = rows.astype(queries.vectors.dtype)
    single = np.ascontiguousarray(near.T.astype(np.float32))
    norms, far, products = (rows * rows).sum(1).astype(np.float64), near.max(axis=1, initial=0), 0
    for at in range(0, len(queries.ids), QUERIES):
        some = np.arange(at, min(at + QUERIES, len(queries.ids)))
        gap, one_gap = np.zeros((len(some), len(rows)), np.float32), np.empty((len(some), len(rows)), np.float32)
        asked = queries.near[some].astype(np.float32)
        for p in range(near.shape[1]):
            np.subtract(asked[:, p, None], single[None, p], out=one_gap)
            np.maximum(gap, np.abs(one_gap, out=one_gap), out=gap)
        gap = np.maximum(gap - GAP_SLACK * (queries.near[some].max(axis=1, initial=0)[:, None] + far[None, :]), 0)
        size = queries.norms[some, None].astype(np.float64) + norms[None, :]
        upper = (size - gap * gap) / 2 + SLACK * size
        for line, q in enumerate(some.tolist()):
            one = np.array([q])
            bound = upper[line]
            alive = np.flatnonzero((bound >= best.least(one)[0]) & (ids != queries.ids[q]))
            order, step = alive[np.argsort(-bound[alive])], FIRST
            while len(order):
                part, order, step = order[:step], order[step:], 4 * step
                part = part[bound[part] >= best.least(one)[0]]
                if not len(part):
                    break
                products += len(part)
                best.take(one, dot(queries.vectors[one], rows[part]).astype(np.int64), ids[part])
    return products


def far_apart(vectors: np.ndarray, count: int) -> np.ndarray:
    """The places of so many vectors, the first and then each the one farthest from all before."""
    own, left = [], np.full(len(vectors), np.inf)
    while len(own) < min(count, len(vectors)):
        k = int(left.argmax()) if own else 0
        own.append(k)
        left = np.minimum(left, distances(vectors, vectors[k : k + 1])[:, 0])
        left[k] = -1
    return np.array(own, np.int64)


def measured(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """*rows* (vec_id, asked, v) with near, the distances of v to the pivots."""
    dims = pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                near = distances(matrix(part.column(2), dims), pivots)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * len(pivots), pa.int32()), pa.array(near.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, flat], ["vec_id", "asked", "v", "near"])

    return rows.select("vec_id", "asked", "v").mapInArrow(run, "vec_id long, asked boolean, v array<long>, near array<double>")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, pivots: int = 64, block: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with *is_query* the k best others by integer inner product.

    Components become floor(scale * x).  All rows but those with the query's own id are
    candidates; ties go to the smaller id; fewer than k candidates give fewer
    rows, none gives none.  Vectors that are null or hold a null or non-finite component
    take no part, nor do rows without an id.  Of vectors of different lengths the shorter counts as filled up
    with zeros; an empty one scores 0.  Repeated rows are candidates each; a query id's repeated rows are one
    query, by the least of its vectors.  Pivots: *pivots* vectors far apart from each other, of the SAMPLE ones of the lowest hash of their id.
    A table without rows, without queries or without a valid vector gives no rows.  Sums are longs.  Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, is_query, id_col, vector_col, scale)
    size = rows.agg(F.max(F.size("v")).alias("dims"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))).alias("most")).first()
    dims, most = size.dims or 0, size.most or 0
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").select("vec_id", "v").limit(SAMPLE).collect()
    drawn = _filled([r.v for r in sample], dims)
    own = far_apart(drawn, pivots)
    fixed = drawn[own], np.array([sample[k].vec_id for k in own], np.int64)
    rows = settle(measured(rows, fixed[0]))
    asked = rows.where("asked").groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id")
    path, part = new_path(spark), []
    found = settle(spark.createDataFrame([], "query_id long, vec_id long, score long"), path)
    for row in asked.toLocalIterator():
        part.append(row)
        if len(part) == block:
            found, part = settle(_searched(rows, part, fixed, dims, most, k), path), []
    if part:
        found = settle(_searched(rows, part, fixed, dims, most, k), path)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _filled(vectors: list[list[int]], dims: int) -> np.ndarray:
    return np.array([v + [0] * (dims - len(v)) for v in vectors], np.int64).reshape(len(vectors), dims)


def _searched(rows: DataFrame, block: list, fixed: tuple[np.ndarray, np.ndarray], dims: int, most: float, k: int) -> DataFrame:
    """Each task's best k for the queries of a block."""
    queries = Queries(np.array([r.vec_id for r in block], np.int64), _filled([r.v for r in block], dims), *fixed, 4 * most * most * max(1, dims) < 2**53, k)
    sent = rows.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = sent.value
        best = Best(queries)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                near = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(part), len(queries.pivots))
                search(queries, best, part.column(0).to_numpy(zero_copy_only=False), matrix(part.column(1), dims), near)
        q, i = np.nonzero(best.score > NONE)
        yield pa.RecordBatch.from_arrays([pa.array(queries.ids[q]), pa.array(best.id[q, i]), pa.array(best.score[q, i])], ["query_id", "vec_id", "score"])

    return rows.select("vec_id", "v", "near").mapInArrow(run, "query_id long, vec_id long, score long")
