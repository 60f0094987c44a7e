"""Pages that overlap, and the answers of the service."""

from pyspark.sql import functions as F

from tallyloom.functions import similarity
from tallyloom.operators import pages
from tallyloom.plans import api
from tallyloom.sources import sinks

NAMES = ["Aaronson", "Bellatrix", "Casparus", "Dorothea", "Evangeline", "Ferdinand", "Guinevere", "Hieronymus"]


def test_pages_are_stitched(spark):
    lines = [("r", 0, i, NAMES[i]) for i in range(5)] + [("r", 1, i, NAMES[i + 2].replace("a", "o", 1) if i == 1 else NAMES[i + 2]) for i in range(5)] + [("r", 2, 0, "unlike all")]
    df = spark.createDataFrame(lines, "run_id string, page int, division int, text string")
    offsets = pages.page_offsets(df)
    assert [tuple(r) for r in offsets.select("page", "offset", "votes").collect()] == [(1, 2, 3)]
    got = pages.stitched(df, offsets).where("page = 1").orderBy("place").collect()
    assert [r.place for r in got] == [2, 3, 4, 5, 6]
    names = pages.gathered(pages.stitched(df, offsets).withColumn("confidence", F.lit(1.0)), ["run_id", "place"])
    assert names.where("place = 3").first().seen == 2


def test_line_divisions(spark):
    rows = [("r", 0, "Name", 0, 30, 0.0, [90.0, 80.0]), ("r", 0, "Other", 40, 70, 50.0, [1.0]), ("r", 0, "no", 80, 90, 9.0, [1.0]), ("r", 1, "Alone", 0, 30, 5.0, [1.0])]
    df = spark.createDataFrame(rows, "run_id string, page int, text string, y0 int, y1 int, confidence double, symbols array<double>")
    got = pages.line_divisions(df, 40).orderBy("division").collect()
    assert [(r.text, r.division, r.confidence) for r in got] == [("Name", 0, 42.5), ("Other", 1, 50.0)]


def test_pairs_are_each_pair():
    a, b = ["", "abc", "Eurega", "0O", "x"], ["abc", "", "Eureka", "oo", "yyyyyy"]
    assert similarity.warped_pairs(a, b).tolist() == [similarity.warped_distance(x, y) for x, y in zip(a, b, strict=True)]


def test_status_and_entities(spark):
    log = spark.createDataFrame([("r", 1, "READING", "A", "*"), ("r", 2, "COMPLETE", "D", "N")], "run_id string, frame_id long, status string, shown string, expected string")
    people = spark.createDataFrame([("r", 0, "Sam", -5, 10.0, ["Sam", "San"], b"0", [b"0", b"1"]), ("r", 1, None, None, None, [], None, [])], "run_id string, user_idx int, name string, length int, ocr_ms double, aliases array<string>, best_img binary, images array<binary>")
    timing = spark.createDataFrame([("r", 0), ("r", 1000)], "run_id string, ms long")
    pings = spark.createDataFrame([("r", "a", 0), ("r", "a", 9), ("r", "b", 1)], "run_id string, ip string, s int").withColumn("ts", F.timestamp_seconds("s"))
    r = api.status(log, people, timing, pings, fps=2).first()
    assert (r.state, r.screen_state, r.known, r.users, r.lag_time, r.lag_to_live, r.all_viewers, r.viewers) == ("COMPLETE", "D", 1, 2, 10.0, 0.0, 2, 1)
    assert api.image_by_name(people, "San").first().user_idx == 0
    assert bytes(api.image_by_index(people, 0, 1).first().image) == b"1" and api.image_by_index(people, 1, 3).first().image is None
    assert api.last_lengths(people).first().lengths == [-5, None]
    assert [x.name for x in api.user_list(people).collect()] == ["Sam", None]


def test_short_searches_ask_nothing(spark):
    people = spark.createDataFrame([(0, ["Malice"]), (1, ["Barou"])], "entity int, aliases array<string>")
    assert api.find_name(people, " ab ") is None is api.find_name(people, None)
    assert api.find_name(people, " Baro ").first().entity == 1


def test_texts_of_a_run(spark):
    log = spark.createDataFrame([("r", 1, "A", "*", 2, True, "length", 0)], "run_id string, frame_id long, shown string, expected string, offset int, good boolean, by string, first_index int")
    timing = spark.createDataFrame([("r", 1, 12.345)], "run_id string, frame_id long, process double")
    text = sinks.log_text(log, timing).first().value.split("\n")
    assert text[:2] == ["seen     A", "expected *"] and text[3] == "frame 1 took 12.35 ms"
    checks = spark.createDataFrame([("r", "color", 1.0), ("r", "color", 2.0), ("r", "quick", 0.5)], "run_id string, kind string, ms double")
    assert sinks.timing_means(checks).first().value == "mean of a colour check: 1.50 ms\nmean of a quick look check: 0.50 ms\nmean of a length check: -"
