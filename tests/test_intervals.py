"""Points in intervals against every pair, split stretches, and reports with medians."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import intervals, reconcile

POINTS, HELD = "run string, at long, p int", "run string, a long, b long, i int"


def rows_of(seed, n=150):
    rng = random.Random(seed)
    runs = ["hot"] * 6 + ["x", "y", None]
    points = [(rng.choice(runs), rng.choice([None, *(rng.randrange(-50, 400) for _ in range(9))]), k) for k in range(n)]
    held = []
    for k in range(n):
        a = rng.randrange(-60, 400)
        held.append((rng.choice(runs), rng.choice([a, a, a, a, None]), rng.choice([a + 1, a + 3, a + rng.randrange(300), a - 2, a, None, a + 2**40]), k))
    return points, held


def every_pair(points, held, keyed):
    return sorted((p, i) for run, at, p in points for other, a, b, i in held if at is not None and a is not None and a <= at and (b is None or at < b) and (not keyed or (run is not None and run == other)))


@pytest.mark.parametrize(("seed", "most"), [(1, 50_000), (2, 3), (3, 1)])
@pytest.mark.parametrize("keyed", [True, False])
def test_pairs_are_those_of_all(spark, seed, most, keyed):
    points, held = rows_of(seed)
    left, right = spark.createDataFrame(points, POINTS), spark.createDataFrame(held, HELD)
    if not keyed:
        right = right.withColumnRenamed("run", "other")
    met = intervals.points_in(left, right, ["run"] if keyed else [], "at", "a", "b", most)
    assert met.columns == ["run", "at", "p", *([] if keyed else ["other"]), "a", "b", "i"]
    assert sorted((r.p, r.i) for r in met.collect()) == every_pair(points, held, keyed)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize(("least", "most"), [(1000, 50_000), (10, 50), (1, 7)])
def test_a_result_can_have_some_columns(spark, monkeypatch, least, most):
    monkeypatch.setattr(intervals, "LEAST_POINTS", least)
    points, held = rows_of(9)
    points = [*points, *(("x", 111, 1000 + k) for k in range(60))]
    left, right = spark.createDataFrame(points, POINTS), spark.createDataFrame(held, HELD).withColumnRenamed("run", "other")
    want = every_pair(points, held, False)
    met = intervals.points_in_any(left, right, "at", "a", "b", ["i", "p"], most)
    assert met.columns == ["i", "p"] and sorted((r.p, r.i) for r in met.collect()) == want
    assert sorted(r.i for r in intervals.points_in_any(left, right, "at", "a", "b", ["i"], most).collect()) == sorted(i for _, i in want)
    assert sorted(r.p for r in intervals.points_in_any(left, right, "at", "a", "b", ["p"], most).collect()) == sorted(p for p, _ in want)


def test_intervals_without_keys_are_sent_once(spark):
    points, held = rows_of(4)
    left, right = spark.createDataFrame(points, POINTS), spark.createDataFrame(held, HELD).withColumnRenamed("run", "other")
    plan = intervals.points_in(left, right, [], "at", "a", "b")._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    for none in (left.limit(0), right), (left, right.limit(0)):
        assert intervals.points_in(*none, [], "at", "a", "b").collect() == []


def test_lists_go_on_in_the_next_batch(spark):
    points = spark.range(150_000).select(F.floor(F.col("id") / 3).alias("at"), "id")
    held = spark.createDataFrame([(0, 50_000), (49_999, None), (10, 11)], "a long, b long")
    assert sorted(r.n for r in intervals.points_in_any(points, held, "at", "a", "b", most=200_000).groupBy("a").agg(F.count("*").alias("n")).collect()) == [3, 3, 150_000]


def test_frames_without_entities_and_none_at_all(spark):
    frames = spark.createDataFrame([("r", 5), ("r", 6), ("s", 5)], "run_id string, frame long")
    entities = spark.createDataFrame([("r", 1, 5, 6), ("r", 2, 6, None), ("r", 3, 9, None)], "run_id string, entity int, entered long, left long")
    assert sorted(tuple(r) for r in intervals.on_screen(frames, entities).collect()) == [("r", 5, 1), ("r", 6, 2)]
    assert intervals.on_screen(frames.limit(0), entities).collect() == [] and intervals.on_screen(frames, entities.limit(0)).collect() == []


def test_reports_have_exact_medians(spark):
    rng = random.Random(6)
    data = [(rng.choice(["a", "b", None]), rng.choice(["match", "other"]), rng.choice([None, *range(13)])) for _ in range(301)]
    frame = spark.createDataFrame(data, "run string, kind string, score int")
    got = reconcile.score_report(frame, ["run", "kind"], "score", [["run", "kind"], ["run"], []]).collect()
    want = []
    for keep in ((0, 1), (0,), ()):
        groups = {}
        for row in data:
            if row[2] is not None:
                groups.setdefault(tuple(row[k] if k in keep else None for k in range(2)), []).append(row[2])
        for key, x in groups.items():
            x.sort()
            want.append((*key, len(x), x[-(-len(x) // 4) - 1], statistics.median(x), x[-(-len(x) * 3 // 4) - 1], round(statistics.fmean(x), 9)))
    assert sorted(((r.run, r.kind, r.n, r.low, r.median, r.high, round(r["mean"], 9)) for r in got), key=repr) == sorted(want, key=repr)
    assert reconcile.score_report(frame.where(F.lit(False)), ["run"], "score", [["run"]]).collect() == []
