"""Late readings over two streams against the same join of tables, and plain Python."""

import random

from pyspark.sql import functions as F

from tallyloom.streaming import jobs
from tests.test_streams import all_rows, source

JOBS, READINGS = "run string, job long, asked_s long", "run string, job long, came_s long, text string"


def timed(df, name):
    return df.withColumn(name, F.timestamp_seconds(f"{name}_s")).drop(f"{name}_s")


def cases():
    rng = random.Random(9)
    asked = [(rng.choice("ab"), k, 500 + rng.randrange(60)) for k in range(60)]
    came = [(r, k, s + rng.choice([0, 1, 3, 5, 6, 9]), f"text {k}") for r, k, s in asked if rng.random() < 0.8] + [("c", 5, 530, "of no job"), (None, 1, 520, "of none")]
    return asked, came


def told(rows):
    return sorted(((r.run, r.job, r.text, r.status) for r in rows if r.job < 1000), key=repr)


def by_hand(asked, came):
    out, used = [], set()
    for run, k, s in asked:
        hits = [x for x in came if x[0] == run and x[1] == k and s <= x[2] <= s + 5]
        used.update(hits)
        out += [(run, k, x[3], "read") for x in hits] or [(run, k, None, "unread")]
    return sorted(out + [(x[0], x[1], x[3], "late") for x in came if x not in used], key=repr)


def test_tables(spark):
    asked, came = cases()
    met = jobs.met_readings(timed(spark.createDataFrame(asked, JOBS), "asked"), timed(spark.createDataFrame(came, READINGS), "came"), ["run", "job"], "asked", "came")
    assert met.columns == ["run", "job", "asked", "text", "came", "status"] and told(met.collect()) == by_hand(asked, came)
    counts = {r.run: (r.read, r.unread, r.late) for r in jobs.job_counts(met, ["run"]).collect()}
    assert counts["c"] == (0, 0, 1) and sum(map(sum, counts.values())) == len(by_hand(asked, came))


def test_streams(spark, tmp_path):
    asked, came = cases()
    asked, came = (sorted(x, key=lambda r: r[2]) for x in (asked, came))
    ends = [[("z", 1000 + i, 5000 + i)] for i in range(3)]
    left = source(spark, tmp_path / "jobs", [asked[:20], asked[20:40], asked[40:], *ends], JOBS)
    right = source(spark, tmp_path / "readings", [came[:15], came[15:30], came[30:], *([(r, j + 1000, s, "")] for e in ends for r, j, s in e)], READINGS)
    met = jobs.met_readings(timed(left, "asked"), timed(right, "came"), ["run", "job"], "asked", "came")
    assert told(all_rows(spark, met, "met", tmp_path / "ck")) == by_hand(asked, came)
