"""Streams to their end: images cut from chunks, quiet runs, viewers by window, frames written by batch."""

from pyspark.sql import functions as F

from tallyloom.operators import lifecycle, tracking
from tallyloom.sources import frames, sinks
from tallyloom.streaming import tracker


def source(spark, path, rows, schema):
    """A stream that gives one batch for each list of rows."""
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(path / f"p{i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path / "*"))


def all_rows(spark, stream, name, path, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(path)).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None
    return spark.table(name).collect()


def test_images_are_cut_across_batches(spark, tmp_path):
    images = [b"\xff\xd8" + bytes([i]) * 20 + b"\xff\xd9" for i in range(3)]
    data = b"".join(images)
    chunks = [[("s", i, data[i * 12 : i * 12 + 12])] for i in range(6)]
    stream = source(spark, tmp_path / "in", chunks, "stream string, seq int, chunk binary")
    got = all_rows(spark, frames.cut_image_stream(stream), "cut", tmp_path / "ck")
    assert [(r.image_no, bytes(r.image), r.failed) for r in sorted(got)] == [(i, x, False) for i, x in enumerate(images)]


SECONDS = [[("a", 0), ("a", 3), ("b", 1)], [("a", 20), ("b", 2)], [("c", 100)]]


def timed(spark, path):
    return source(spark, path, SECONDS, "run string, s long").withColumn("ts", F.timestamp_seconds("s"))


def test_quiet_runs_end_once_the_watermark_has_passed(spark, tmp_path):
    got = all_rows(spark, tracker.quiet_runs(timed(spark, tmp_path / "in"), ["run"], "ts"), "quiet", tmp_path / "ck")
    assert sorted((r.run, r.started.second, r.ended.second, r.n) for r in got) == [("a", 0, 3, 2), ("a", 20, 20, 1), ("b", 1, 2, 2)]


def test_viewers_by_window(spark, tmp_path):
    got = all_rows(spark, tracker.viewers_per_window(timed(spark, tmp_path / "in"), "run", "ts", "30 seconds", "10 seconds"), "viewers", tmp_path / "ck")
    assert [r.active for r in got] == [2]


def test_frames_are_written_by_batch(spark, tmp_path):
    stream = source(spark, tmp_path / "in", [[("r", 0, b"a")], [("r", 1, b"b")]], "run_id string, image_no long, image binary")
    query = sinks.write_frames(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(120)
    assert query.exception() is None and spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_a_run_that_is_over_keeps_no_entities(spark, tmp_path):
    schema = "run_id string, frame_id long, vidx int, appear boolean, length int, len_checked boolean, color string"
    seen = [("r", f, v, True, -100 - v, True, None) for f in range(2) for v in range(3)]
    quiet = [("r", f, 0, False, None, False, None) for f in range(2, 160)]
    late = [("r", 200, 0, True, -100, True, None)]
    stream = source(spark, tmp_path / "in", [seen, quiet, late], schema)
    got = all_rows(spark, tracker.track_stream(stream), "over", tmp_path / "ck")
    want = tracking.track(spark.createDataFrame([*seen, *quiet, *late], schema)).collect()
    assert sorted(got, key=lambda r: r.frame_id) == sorted(want, key=lambda r: r.frame_id) and max(r.frame_id for r in got) == 152
    assert tracker.tracked_entities(spark, str(tmp_path / "ck")).count() == 0
    run = spark.read.format("statestore").option("stateVarName", "run").load(str(tmp_path / "ck")).select("value.*").first()
    assert run.status == "COMPLETE"


def moving(frames_):
    """A run whose screen of twenty moves on by one every frame; every length is another."""
    return [("r", f, v, True, -(50 + (f + v) * 7 % 240), True, "UNSUB_WHITE" if (f + v) % 3 else "SUB_BLUE") for f in frames_ for v in range(20)]


def test_what_a_batch_writes_does_not_grow_with_what_has_left(spark, tmp_path):
    schema = "run_id string, frame_id long, vidx int, appear boolean, length int, len_checked boolean, color string"
    parts = [moving(range(i * 8, i * 8 + 8)) for i in range(8)]
    got = all_rows(spark, tracker.track_stream(source(spark, tmp_path / "in", parts, schema)), "moving", tmp_path / "ck")
    want = tracking.track(spark.createDataFrame([r for p in parts for r in p], schema)).collect()
    assert sorted(got, key=lambda r: r.frame_id) == sorted(want, key=lambda r: r.frame_id) and want[-1].first_index > 40
    held = tracker.tracked_entities(spark, str(tmp_path / "ck"))
    assert held.count() == max(r.first_index for r in want) + tracking.SCREEN and held.where("left is not null").count() == max(r.first_index for r in want)
    # What a batch changed of the entities: the same number in the third and in the last.
    rows = {b: {r.idx: tuple(r) for r in tracker.tracked_entities(spark, str(tmp_path / "ck"), b).collect()} for b in (1, 2, 6, 7)}
    written = [len(set(rows[b].values()) - set(rows[b - 1].values())) for b in (2, 7)]
    assert written[0] == written[1] < 40


CONTROL = [("a", 1, "screen"), ("a", 2, "start"), ("a", 3, "start"), ("a", 4, "screen"), ("a", 5, "other"), ("a", 6, "quiet"), ("a", 7, "force"), ("a", 8, "clear"), ("b", 1, "force"), ("b", 2, "stop"), ("b", 3, None), ("b", 4, "start")]


def test_runs_are_moved_on_by_events(spark, tmp_path):
    timed = lambda df: df.withColumn("at", F.timestamp_seconds("s"))
    schema = "run_id string, s long, event string"
    told = lifecycle.follow(timed(spark.createDataFrame(CONTROL, schema)))
    batch = sorted((r.run_id, r.at, r.after) for r in told.collect())
    assert [x[2] for x in batch] == ["STOPPED", "WAITING", "WAITING", "READING", "READING", "COMPLETE", "READING", "STOPPED", "READING", "STOPPED", "STOPPED", "WAITING"]
    last = {r.run_id: r for r in lifecycle.entered(told).collect()}
    assert (last["a"].state, last["a"].reading, last["b"].state, last["b"].waiting.second, last["b"].reading.second) == ("STOPPED", None, "WAITING", 4, 1)
    stream = timed(source(spark, tmp_path / "in", [CONTROL[:3], CONTROL[3:10], CONTROL[10:]], schema))
    got = all_rows(spark, tracker.follow_stream(stream), "followed", tmp_path / "ck")
    assert sorted((r.run_id, r.at, r.after) for r in got) == batch


def test_folders_are_replayed_by_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in (1, 2, 3):
        (tmp_path / "in" / f"{n}.png").write_bytes(bytes([n]))
    got = all_rows(spark, frames.replayed_folder(spark, str(tmp_path / "in"), 2), "replayed", tmp_path / "ck")
    assert sorted((r.frame_no, bytes(r.image)) for r in got) == [(2, b"\x02"), (3, b"\x03")]
