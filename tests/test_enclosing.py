"""The least enclosing colour against a search of every centre."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import color, enclosing
from tallyloom.plans import catalog


def full_search(colors, top):
    """(centre, largest square) by trying every centre, and the redmean column's formula in doubles."""
    every = np.array(np.meshgrid(*[np.arange(top + 1)] * 3, indexing="ij")).reshape(3, -1).T
    worst = np.zeros(len(every), np.int64)
    for at in range(0, len(every), 4096):
        worst[at : at + 4096] = enclosing.squares(every[at : at + 4096], colors).max(axis=1)
    return every[worst.argmin()].tolist(), int(worst.min())


@pytest.mark.parametrize("top", [3, 15, 31])
def test_small_cubes(top):
    rng = np.random.default_rng(top)
    for n in (1, 2, 3, 5, 20, 300):
        colors = rng.integers(0, top + 1, (n, 3))
        center, square = enclosing.enclosing(colors, top)
        assert (center.tolist(), square) == full_search(colors, top)


def test_the_whole_cube_has_no_better_center_near_or_far():
    rng = np.random.default_rng(7)
    for n in (2, 10, 2000):
        colors = rng.integers(0, 256, (n, 3))
        center, square = enclosing.enclosing(colors)
        tried = np.concatenate((rng.integers(0, 256, (20_000, 3)), np.clip(center + np.array(np.meshgrid(*[np.arange(-6, 7)] * 3)).reshape(3, -1).T, 0, 255)))
        assert min(int(enclosing.squares(tried[i : i + 1000], colors).max(axis=1).min()) for i in range(0, len(tried), 1000)) >= square


def test_squares_are_the_column_s_distance(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 256, (50, 3)), rng.integers(0, 256, (50, 3))
    frame = spark.createDataFrame([(*map(int, x), *map(int, y)) for x, y in zip(a, b, strict=True)], "a int, b int, c int, d int, e int, f int").coalesce(1)
    got = [r[0] for r in frame.select(color.redmean(tuple(F.col(c) for c in "abc"), tuple(F.col(c) for c in "def"))).collect()]
    assert np.allclose(got, [np.sqrt(enclosing.squares(x[None], y[None])[0, 0] / 512) for x, y in zip(a, b, strict=True)])


def test_groups_and_what_can_not_be_farthest(spark):
    rng = np.random.default_rng(5)
    data = [(k, *(int(x) for x in rng.integers(0, 12, 3))) for k in (0, 1) for _ in range(900)] + [(9, 1, 2, 3)] * 2 + [(8, None, 1, 1), (7, 5, None, 1), (7, 4, 4, 4)]
    frame = spark.createDataFrame(data, "k int, r int, g int, b int")
    kept = enclosing.may_be_farthest(frame.dropna(), ["k"]).where("k = 0")
    assert kept.count() < 0.7 * frame.where("k = 0").distinct().count()
    got = {r.k: ([r.r, r.g, r.b], round(r.distance**2 * 512)) for r in enclosing.enclosing_colors(frame, ["k"], top=11).collect()}
    assert got == {k: full_search(np.array([x[1:] for x in data if x[0] == k and None not in x]), 11) for k in (0, 1, 7, 9)}
    assert enclosing.enclosing_colors(frame.limit(0), ["k"]).collect() == []


def test_the_query_takes_the_whole_table(spark):
    assert catalog.enclosing_colors(spark, "/root/testdata/sf0.001").count() == 5
