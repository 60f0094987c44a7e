"""Whitening of embeddings by matrix-free block Lanczos.

The covariance is never formed.  A pass takes a block of directions to all tasks, and each gives the sum of its centred rows times
their products with these; the sums are as large as the block.  Vectors are whole numbers, so their sums and what a row differs from the mean, times the number of rows, are exact,
and are divided once.  The driver holds the basis, which has at most as many columns as vectors have components, and no rows.

Every new block is orthogonalised twice against the whole basis.  Where less than a block is left of it, as after an invariant
subspace, random directions take its place (a restart on breakdown).  The passes end when the residuals of all wanted pairs are small, or the basis is the whole space.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, DoubleType, IntegerType, LongType, StructField, StructType

from tallyloom.llm.common import settle
from tallyloom.llm.vector_search import matrix, valid

#: Directions of a block beyond the wanted ones.
SPARE = 8
#: Residuals that are small, as a share of the largest eigenvalue.
RESIDUAL = 1e-13
#: Eigenvalues below this share of the largest are zero: the vectors don't extend in that direction.
ZERO = 1e-11
#: Of a block's column, what must be left of it outside the basis.
LEFT = 1e-10
#: Numbers of a batch that are centred at once.
AT_ONCE = 1 << 20
#: Bits of the parts in which squares are summed.
LIMB = 20
MOST_DIGITS = 10**38


@dataclass
class Whitening:
    """What is fitted: *sums* by component over *n* vectors, unit eigenvectors as columns of *directions*, their eigenvalues, largest first, and the trace."""

    n: int
    sums: np.ndarray
    directions: np.ndarray
    values: np.ndarray
    trace: float
    passes: int

    @property
    def map(self) -> np.ndarray:
        """The matrix that centred vectors are multiplied by."""
        return self.directions / np.sqrt(self.values)


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * c) of every valid vector.  What is added to all entries alike changes nothing below."""
    own = vectors.select(F.col(id_col).alias("id"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("v"))
    return own.where(valid(F.col("v"))).withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("long")))


def square_sums(rows: np.ndarray) -> list[int]:
    """The sum of squares of each row of longs, exact: by parts of 20 bits."""
    low, rest = rows & ((1 << LIMB) - 1), rows >> LIMB
    middle, high = rest & ((1 << LIMB) - 1), rest >> LIMB
    parts = [(a * b).sum(1).tolist() for a, b in ((low, low), (low, middle), (middle, middle), (low, high), (middle, high), (high, high))]
    return [ll + (2 * lm << LIMB) + (mm + 2 * lh << 2 * LIMB) + (2 * mh << 3 * LIMB) + (hh << 4 * LIMB) for ll, lm, mm, lh, mh, hh in zip(*parts, strict=True)]


def apart(rows: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * row - sums, exact as long as that is a long."""
    return rows * np.int64(n) - sums


def _chunks(batches: Iterator[pa.RecordBatch], column: int, dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of bounded size with the vectors of a column as rows."""
    step = max(1, AT_ONCE // max(1, dims))
    for batch in batches:
        for at in range(0, len(batch), step):
            part = batch.slice(at, step)
            yield part, matrix(part.column(column), dims)


def _added(rows: DataFrame, width: int) -> np.ndarray:
    """The sum of (i, row) over all tasks, by i; as many rows as i has values come to the driver."""
    sums = rows.groupBy("i").agg(F.array(*(F.sum(F.get("row", F.lit(j))) for j in range(width))).alias("row"))
    found = sorted(sums.toLocalIterator(), key=lambda r: r.i)
    return np.array([r.row for r in found], np.float64).reshape(len(found), width)


def _pass(rows: DataFrame, n: int, sums: np.ndarray, block: np.ndarray, gram: bool = False) -> np.ndarray:
    """V times *block*, or with *gram* the covariance of what *block* makes of the vectors, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((block.shape[1] if gram else len(sums), block.shape[1]))
        for _, v in _chunks(batches, 0, len(sums)):
            centred = apart(v, n, sums) / n
            seen = centred @ block
            total += (seen if gram else centred).T @ seen
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    return _added(rows.select("v").mapInArrow(run, "i int, row array<double>"), block.shape[1]) / n


def fresh(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Orthonormal columns that span what *block* has outside *basis*; random directions stand in for columns of which nothing is left there."""
    out = basis[:, :0]
    for column in block.T[: len(basis) - basis.shape[1]]:
        had = np.linalg.norm(column)
        for tried in range(3):
            x = column / had if had else column
            held = np.hstack((basis, out))
            for _ in range(2):
                x = x - held @ (held.T @ x)
            left = np.linalg.norm(x)
            if had and left > LEFT:
                x /= left
                out = np.hstack((out, (x - held @ (held.T @ x))[:, None]))
                break
            column = rng.standard_normal(len(basis))
            had = np.linalg.norm(column)
        else:
            break
    return out


def lanczos(apply: Callable[[np.ndarray], np.ndarray], dims: int, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """(eigenvalues, largest first, unit eigenvectors, passes) of a symmetric map that is only known by what it makes of blocks of columns."""
    rng, width = np.random.default_rng(seed), min(dims, k + SPARE)
    basis = images = np.zeros((dims, 0))
    block, passes = rng.standard_normal((dims, width)), 0
    while True:
        block = fresh(block, basis, rng)
        image = apply(block)
        passes += 1
        basis, images = np.hstack((basis, block)), np.hstack((images, image))
        inner = basis.T @ images
        values, y = np.linalg.eigh((inner + inner.T) / 2)
        values, y = values[::-1][:k], y[:, ::-1][:, :k]
        vectors = basis @ y
        residual = np.linalg.norm(images @ y - vectors * values, axis=0)
        if basis.shape[1] >= dims or residual.max(initial=0) <= RESIDUAL * max(values[0], 0):
            return values, vectors / np.linalg.norm(vectors, axis=0), passes
        block = image


def fit(rows: DataFrame, k: int = 32) -> tuple[DataFrame, Whitening]:
    """*rows* (id, v), v whole numbers, with the column deviation, written once; and what is fitted to all of them."""
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 0

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dims, np.int64)
        for _, v in _chunks(batches, 0, dims):
            n, total = n + len(v), total + v.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, dims), pa.int32()), pa.array([n, *total.tolist()], pa.int64())], ["i", "x"])

    found = {r.i: r.x for r in rows.select("v").mapInArrow(totals, "i int, x long").groupBy("i").agg(F.sum("x").alias("x")).toLocalIterator()}
    n, sums = found.get(-1, 0), np.array([found.get(i, 0) for i in range(dims)], np.int64)

    def deviate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, v in _chunks(batches, 1, dims):
            far = [x if x < MOST_DIGITS else None for x in square_sums(apart(v, n, sums))]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(far, pa.decimal128(38, 0))], ["id", "v", "deviation"])

    schema = StructType([rows.schema["id"], StructField("v", ArrayType(LongType())), StructField("deviation", DecimalType(38, 0))])
    own = settle(rows.mapInArrow(deviate, schema))
    trace = (own.agg(F.sum(F.col("deviation").cast("double"))).first()[0] or 0.0) / max(1, n) ** 3
    values, vectors, passes = np.zeros(0), np.zeros((dims, 0)), 0
    if dims and trace > 0:
        values, vectors, passes = lanczos(lambda block: _pass(own, n, sums, block), dims, min(k, dims))
        kept = values > ZERO * values[0]
        values, vectors = values[kept], vectors[:, kept]
        # Either sign is right; one is taken, so that reruns agree.
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return own, Whitening(n, sums, vectors, values, trace, passes)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 32, scale: int = 64) -> DataFrame:
    """(*id_col*, component, n, deviation, whitened, explained, identity_error): a row for each valid vector and component up to *k*.

    Entries become floor(scale * c).  All vectors that are neither null nor hold a null or non-finite entry are the fit list, repeated rows and rows without an id
    included; of vectors of different lengths the shorter counts as filled up with zeros.  deviation is exact, a decimal, null beyond 38 digits.  Components are numbered from 1 by falling
    eigenvalue; directions in which the vectors don't extend are none, so fewer vectors than that, or equal ones, give fewer components, and one vector or an empty table no row.
    explained: the eigenvalue's share of the trace, which is the sum of deviations.  Entries times rows must stay below 2^62.  Other columns are not read.
    """
    own, found = fit(quantised(vectors, id_col, vector_col, scale), k)
    size = len(found.values)
    told = StructType([StructField(id_col, vectors.schema[id_col].dataType), StructField("component", IntegerType()), StructField("deviation", DecimalType(38, 0)), StructField("whitened", DoubleType())])
    error = float(np.abs(_pass(own, found.n, found.sums, found.map, gram=True) - np.eye(size)).max()) if size else 0.0
    n, sums, made = found.n, found.sums, found.map

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, v in _chunks(batches, 1, len(sums)):
            at = pa.array(np.repeat(np.arange(len(v)), size))
            white = (apart(v, n, sums) / n @ made).ravel()
            yield pa.RecordBatch.from_arrays([part.column(0).take(at), pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(v))), part.column(2).take(at), pa.array(white)], told.names)

    rows = own.mapInArrow(run, told) if size else own.sparkSession.createDataFrame([], told)
    share = F.get(F.array(*(F.lit(float(x)) for x in found.values / (found.trace or 1))), F.col("component") - 1) if size else F.lit(None).cast("double")
    return rows.select(id_col, "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))
