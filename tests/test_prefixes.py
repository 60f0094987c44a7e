"""Prefixes along an order in two levels: states of runs and running sums, against plain folds."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import lifecycle, ranges

NAMES = ["start", "screen", "quiet", "force", "stop", "clear", "other", None]


def fold(rows):
    state, out = {}, []
    for run, at, event in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2] is None, r[2] or "")):
        before = state.get(run, "STOPPED")
        state[run] = lifecycle.MOVES.get((event, before), before)
        out.append((run, at, event, before, state[run]))
    return sorted(out, key=repr)


def told(df):
    return sorted(((r.run_id, r.s, r.event, r.before, r.after) for r in df.withColumn("s", F.unix_seconds("at")).collect()), key=repr)


@pytest.mark.parametrize(("cuts", "n"), [(1, 40), (7, 300), (64, 900)])
def test_states_are_those_of_a_fold(spark, cuts, n):
    rng = random.Random(cuts)
    rows = [("hot" if rng.random() < 0.7 else rng.choice(["a", "b", None]), rng.randrange(n), rng.choice(NAMES)) for _ in range(n)] + [("one", 3, "force")]
    events = spark.createDataFrame(rows, "run_id string, s long, event string").withColumn("at", F.timestamp_seconds("s"))
    assert told(lifecycle.follow(events, cuts)) == fold(rows)


def test_no_rows_and_one_time(spark):
    none = spark.createDataFrame([], "run_id string, at timestamp, event string")
    assert lifecycle.follow(none).collect() == []
    rows = [("r", 5, e) for e in ("stop", "start", "quiet", "screen", "start")]
    assert told(lifecycle.follow(spark.createDataFrame(rows, "run_id string, s long, event string").withColumn("at", F.timestamp_seconds("s")), 4)) == fold(rows)


def test_a_run_of_all_events_is_many_groups_and_no_python(spark):
    """Events of one run lie in as many groups as there are ranges, none with more than a small share of them."""
    events = spark.range(4000).select(F.lit("r").alias("run_id"), F.timestamp_seconds("id").alias("at"), F.when(F.col("id") % 3 == 0, "start").otherwise("screen").alias("event"))
    cuts = ranges.borders(events, F.unix_micros("at"), 32)
    sizes = [r["count"] for r in events.groupBy(ranges.range_of(F.unix_micros("at"), cuts)).count().collect()]
    assert len(sizes) == 32 and max(sizes) < 2 * 4000 / 32
    followed = lifecycle.follow(events, 32)
    plan = followed._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert followed.where("after = 'READING'").count() == 3999


@pytest.mark.parametrize("cuts", [1, 5, 50])
def test_running_sums(spark, cuts):
    rng = random.Random(cuts)
    rows = [(i, rng.randrange(-5, 6)) for i in rng.sample(range(10_000), 400)]
    got = {r.at: r.x for r in ranges.running_sum(spark.createDataFrame(rows, "at long, x long"), "x", "at", cuts).collect()}
    total, want = 0, {}
    for at, x in sorted(rows):
        total += x
        want[at] = total
    assert got == want
    assert ranges.running_sum(spark.createDataFrame([], "at long, x long"), "x", "at").collect() == []
