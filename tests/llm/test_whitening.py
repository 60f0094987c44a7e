"""Whitening against a dense eigensolver, exact sums against whole numbers of any size."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import queries, whitening
from tests.llm.conftest import SF

KIND = "vec_id long, embedding array<double>"


def dense(vectors, k):
    """(exact deviations, eigenvalues, eigenvectors, trace) of floor(64 c) + 1000000."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    far = [[n * c - s for c, s in zip(v, sums, strict=True)] for v in x]
    centred = np.array(far, np.float64) / n
    values, own = np.linalg.eigh(centred.T @ centred / n)
    return [sum(c * c for c in v) for v in far], centred, values[::-1][:k], own[:, ::-1][:, :k], float(np.trace(centred.T @ centred / n))


def checked(got, vectors, ids, k):
    """Holds rows against the dense answer; of eigenvalues that are apart, up to the sign."""
    far, centred, values, own, trace = dense(vectors, k)
    k = len(values)
    assert len(got) == len(vectors) * k and {r.component for r in got} == set(range(1, k + 1)) and {r.n for r in got} == {len(vectors)}
    table = {(r.vec_id, r.component): r for r in got}
    white = np.array([[table[i, c + 1].whitened for c in range(k)] for i in ids])
    assert [int(table[i, 1].deviation) for i in ids] == far
    assert np.abs(white.T @ white / len(ids) - np.eye(k)).max() < 1e-9 and got[0].identity_error < 1e-9
    assert np.allclose([table[ids[0], c + 1].explained for c in range(k)], values / trace, rtol=1e-9)
    want = centred @ own / np.sqrt(values)
    gap = np.abs(np.diff(values, prepend=np.inf, append=0)) / values[0]
    for c in range(k):
        if min(gap[c], gap[c + 1] if c + 1 < k else np.inf) > 1e-6:
            assert np.abs(np.abs(white[:, c]) - np.abs(want[:, c])).max() < 1e-6


def test_the_query_is_the_dense_answer(spark):
    held = [r for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    checked(queries.op12_whitening(spark, SF).collect(), [r.embedding for r in held], [r.vec_id for r in held], 32)


def test_many_passes_where_the_space_is_large(spark):
    rng = np.random.default_rng(3)
    data = rng.standard_normal((400, 240)) * np.geomspace(60, 0.1, 240) + rng.standard_normal(240) * 50
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], KIND).repartition(5)
    checked(whitening.whiten(frame, k=3).collect(), data.tolist(), list(range(400)), 3)
    _, found = whitening.fit(whitening.quantised(frame, "vec_id", "embedding", 64), 3)
    assert 2 < found.passes < 240 // (3 + whitening.SPARE)


def test_odd_rows(spark):
    rng = random.Random(1)
    good = [(i, [rng.uniform(-3, 3) for _ in range(4)]) for i in range(30)] + [(7, [1.0, 2.0, 3.0, 4.0])] * 3 + [(None, [0.5, 0.5, 0.5, 0.25])]
    bad = [(90, None), (91, [1.0, None, 2.0, 3.0]), (92, [float("nan"), 1.0, 1.0, 1.0]), (93, [1.0, float("inf"), 0.0, 0.0])]
    frame = spark.createDataFrame(good + bad, KIND).withColumns({c: F.lit("x") for c in ("id", "v", "deviation", "component", "n", "i")})
    got = whitening.whiten(frame).collect()
    far, *_ = dense([v for _, v in good], 4)
    assert sorted((r.vec_id if r.vec_id is not None else -1, int(r.deviation)) for r in got if r.component == 1) == sorted((i if i is not None else -1, d) for (i, _), d in zip(good, far, strict=True))
    assert len(got) == 4 * len(good) and got[0].identity_error < 1e-9


@pytest.mark.parametrize(("data", "components"), [([], 0), ([[1.0, 2.0]], 0), ([[1.0, 2.0]] * 5, 0), ([[1.0, 2.0], [3.0, 2.0], [9.0, 2.0]], 1), ([[0.0, 0.0, 1.0], [4.0, 4.0, 1.0], [1.0, 9.0, 1.0]], 2), ([[]], 0), ([[1.0, 1.0], [2.0]], 1)])
def test_directions_without_extent_are_no_components(spark, data, components):
    got = whitening.whiten(spark.createDataFrame([(i, v) for i, v in enumerate(data)], KIND)).collect()
    assert len(got) == components * len(data)
    assert all(abs(sum(r.whitened**2 for r in got if r.component == c) / len(data) - 1) < 1e-9 for c in range(1, components + 1))
    if components:
        assert abs(sum(r.explained for r in got) / len(data) - 1) < 1e-9


def test_squares_are_exact_beyond_longs():
    rng = random.Random(2)
    rows = [[rng.randrange(-(2**61), 2**61) for _ in range(70)] for _ in range(20)] + [[0] * 70, [-1] * 70, [2**61] * 70]
    assert whitening.square_sums(np.array(rows, np.int64)) == [sum(x * x for x in r) for r in rows]


def test_restarts_after_a_breakdown():
    """A map with few different eigenvalues: the Krylov space closes at once, and random directions find the rest."""
    diagonal = np.array([5.0] * 3 + [2.0] * 40 + [0.0] * 57)
    values, vectors, _ = whitening.lanczos(lambda block: diagonal[:, None] * block, 100, 43)
    assert np.allclose(values, [5.0] * 3 + [2.0] * 40, atol=1e-12) and np.abs(vectors.T @ vectors - np.eye(43)).max() < 1e-12
