"""Hulls and least boxes against all faces that any three points make."""

from itertools import combinations

import numpy as np
import pytest

from tallyloom.operators import hulls
from tallyloom.plans import catalog


def brute_faces(points):
    """Normals of all planes through three points that have all points on one side."""
    out = []
    for a, b, c in combinations(points, 3):
        n = np.cross(b - a, c - a)
        if np.linalg.norm(n) > 1e-9:
            n = n / np.linalg.norm(n)
            far = (points - a) @ n
            if far.max() < 1e-9 or far.min() > -1e-9:
                out.append(n)
    return out


def brute_volume(points):
    """The least volume over all faces and all turns along two points' shadow."""
    best = np.inf
    for n in brute_faces(points):
        for a, b in combinations(points, 2):
            u = (b - a) - ((b - a) @ n) * n
            if np.linalg.norm(u) > 1e-9:
                u = u / np.linalg.norm(u)
                best = min(best, np.prod(np.ptp(points @ np.array([n, u, np.cross(n, u)]).T, axis=0)))
    return best


@pytest.mark.parametrize("seed", range(6))
def test_boxes_are_the_least_of_all_faces(seed):
    rng = np.random.default_rng(seed)
    points = rng.integers(0, 8, (12, 3)).astype(float) if seed % 2 else rng.standard_normal((11, 3))
    axes, least, most = hulls.least_box(hulls.hull_points(points))
    assert np.allclose(axes @ axes.T, np.eye(3)) and np.isclose(np.prod(most - least), brute_volume(np.unique(points, axis=0)))
    at = points @ axes.T
    assert (at >= least - 1e-9).all() and (at <= most + 1e-9).all()


def test_hulls_merge_and_hold_all_points():
    rng = np.random.default_rng(3)
    for points in (rng.standard_normal((3000, 3)), rng.integers(0, 256, (4000, 3)).astype(float), rng.integers(0, 4, (500, 3)).astype(float)):
        whole = hulls.hull_points(points)
        parts = hulls.hull_points(np.concatenate([hulls.hull_points(x) for x in np.array_split(points, 7)]))
        direction = rng.standard_normal((200, 3))
        assert np.allclose((whole @ direction.T).max(axis=0), (points @ direction.T).max(axis=0)) and np.allclose((parts @ direction.T).max(axis=0), (points @ direction.T).max(axis=0))
        assert len(whole) < len(points) / 2


@pytest.mark.parametrize(("points", "extent"), [([[1, 2, 3]], [0, 0, 0]), ([[0, 0, 0], [3, 4, 0], [1.5, 2, 0]], [0, 0, 5]), ([[0, 0, 1], [4, 0, 1], [4, 2, 1], [0, 2, 1], [1, 1, 1]], [0, 2, 4]), ([[0, 0, 0], [1, 0, 0], [0, 1, 0], [1, 1, 0], [0, 0, 1], [1, 0, 1], [0, 1, 1], [1, 1, 1]], [1, 1, 1])])
def test_flat_and_straight_points(points, extent):
    own = np.array(points, float)
    for p in (own, own @ np.linalg.qr(np.random.default_rng(1).standard_normal((3, 3)))[0]):
        _, least, most = hulls.least_box(hulls.hull_points(p))
        assert np.allclose(sorted(most - least), extent, atol=1e-7)


def test_groups_over_tasks(spark):
    rng = np.random.default_rng(9)
    data = [(int(k) if k else None, *map(float, p)) for k, p in zip(rng.integers(0, 3, 900), rng.integers(0, 40, (900, 3)), strict=True)] + [(1, None, 0.0, 0.0), (1, float("inf"), 0.0, 0.0), (2, float("nan"), 0.0, 0.0)]
    got = {r.k: r for r in hulls.hull_boxes(spark.createDataFrame(data, "k int, a double, b double, c double").repartition(6), ["k"], ("a", "b", "c")).collect()}
    assert set(got) == {None, 1, 2}
    for k, row in got.items():
        own = np.array([x[1:] for x in data[:900] if x[0] == k])
        _, least, most = hulls.least_box(own)
        assert np.isclose(row.volume, np.prod(most - least)) and np.isclose(row.volume, np.prod(np.array(row.most) - np.array(row.least)))


def test_the_query_has_a_box_for_each_part(spark):
    assert {r.part for r in catalog.hull_boxes(spark, "/root/testdata/sf0.001").collect()} == set(range(5))
