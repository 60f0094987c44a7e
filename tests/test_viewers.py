"""Active viewers of a stream against those of a batch, out of order, over a restart, and with nothing kept at the end."""

import random

from pyspark.sql import functions as F

from tallyloom.operators import windows
from tallyloom.streaming import viewers

SCHEMA = "viewer string, us long"


def timed(df):
    return df.withColumn("ts", F.timestamp_micros("us"))


def batches():
    """Pings of five viewers within ten seconds of order, and one far later that lets the watermark pass all."""
    rng = random.Random(4)
    pings = [(rng.choice("abcde"), rng.randrange(60_000_000)) for _ in range(150)] + [("a", 5_000_000), ("a", 7_000_000), ("a", 9_000_000), ("b", 61_000_000)]
    pings.sort(key=lambda p: p[1] + rng.randrange(9_000_000))
    parts = [pings[i : i + 40] for i in range(0, len(pings), 40)]
    return [*parts, [("z", 200_000_000)], [("z", 200_000_001)], [("z", 200_000_002)]]


def run(spark, path, checkpoint, out):
    stream = timed(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(path / "*")))
    made = viewers.active_viewers(stream, "viewer", "ts", 2000, "10 seconds")
    query = made.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None


def test_the_stream_is_the_batch_also_after_a_restart(spark, tmp_path):
    parts = batches()
    for i, part in enumerate(parts):
        if i == 3:
            run(spark, tmp_path / "in", tmp_path / "ck", tmp_path / "out")
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    run(spark, tmp_path / "in", tmp_path / "ck", tmp_path / "out")
    every = timed(spark.createDataFrame([p for part in parts[:-3] for p in part], SCHEMA))
    want = {(r.at, r.change, r.active) for r in windows.active_changes(every, "viewer", "ts", 2000, 4).collect()}
    got = [(r.at, r.change, r.active) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(got) == len(set(got)) and set(got) == want and max(x[2] for x in want) > 1
    held = spark.read.format("statestore").option("operatorId", 1).option("stateVarName", "stays").load(str(tmp_path / "ck")).select("key.viewer").collect()
    assert {r.viewer for r in held} == {"z"}


def test_stays_are_merged_in_any_order():
    rng = random.Random(1)
    for _ in range(200):
        times = [rng.randrange(100) for _ in range(20)]
        once = viewers.merged([], times, 7)
        rng.shuffle(times)
        step = []
        for t in times:
            step = viewers.merged(step, [t], 7)
        assert once == step
        changes, left = viewers.passed(once, 1000)
        assert not left and sorted(changes) == sorted([(s, 1) for s, _, _ in once] + [(u, -1) for _, u, _ in once])


def test_a_batch_counts_by_brute_force(spark):
    rng = random.Random(2)
    pings = [(rng.choice("abc"), rng.randrange(60) * 500_000) for _ in range(60)] + [(None, 5), ("a", None)]
    got = windows.active_changes(timed(spark.createDataFrame(pings, SCHEMA)), "viewer", "ts", 2000, 5).withColumn("us", F.unix_micros("at")).orderBy("us").collect()

    def active(us):
        return len({v for v, t in pings if v and t is not None and t <= us < t + 2_000_000})

    assert [r.active for r in got] == [active(r.us) for r in got] and got[-1].active == 0 and sum(r.change for r in got) == 0
