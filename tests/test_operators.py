"""Operators over small tables: search, readings, windows, alignment, reconciliation, tracking, streams, sources and rasters."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import images, reconcile, search, tracking, windows
from tallyloom.plans import catalog
from tallyloom.sources import frames, sinks
from tallyloom.streaming import tracker

PEOPLE = [(0, ["Malice", "Chalice", "Alice"]), (1, ["Barou"]), (2, ["Candice"]), (3, ["Dodger", *(f"Dodger{i}" for i in range(1, 6))]), (4, ["Eureka"])]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(PEOPLE, "entity int, aliases array<string>")


def found(people, term, threshold=1e9):
    return search.find(people, [term], threshold=threshold).orderBy("rank").collect()


def test_search_goldens(people):
    alone, dodger, eurega = (found(people, t) for t in ("Alone", "Dodger2", "Eurega"))
    assert alone[0].dist == 4 and [r.dist for r in alone] == [4, 8, 9, 10, 11]
    assert dodger[0].entity == 3 and dodger[0].dist == 0 and [r.entity for r in dodger].count(3) == 1
    assert (eurega[0].entity, eurega[0].dist, eurega[0].match_status) == (4, 2, "LIKELY")
    assert eurega[1].match_status == "UNKNOWN" and eurega[4].match_status == "UNKNOWN"
    assert {r.entity: r.dist for r in eurega} == {0: 10, 1: 10, 2: 13, 3: 11, 4: 2}


def test_search_threshold_is_strict_and_names_are_found(people):
    assert all(r.dist < 12 for r in found(people, "Dodger2", 12))
    assert search.by_name(people, "Chalice").first().entity == 0
    assert search.find_aliases(people, ["Dodger"]).where("dist = 0").first().alias == "Dodger"


def test_islands_and_screen(spark):
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate([1, 1, 2, None, None, 1])], "run string, i int, v int")
    got = sorted(tuple(r)[1:] for r in windows.islands(df, ["run"], ["i"], "v").select("run", "first", "last", "n").collect())
    assert got == [(0, 1, 2), (2, 2, 1), (3, 4, 2), (5, 5, 1)]
    screen = windows.screen(df, ["run"], "i", F.lit(4)).orderBy("slot").collect()
    assert len(screen) == 24 and [r.v for r in screen[:3]] == [None, 1, None]


def test_viewers_stay_while_they_ping(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("a", 9), ("b", 4)], "ip string, s int").select("ip", F.timestamp_seconds(F.col("s")).alias("ts"))
    got = sorted((r.ip, r.since.second, r.until.second) for r in windows.stays(df, "ip", "ts", 2000).collect())
    assert got == [("a", 0, 3), ("a", 9, 11), ("b", 4, 6)]


def test_reconcile_and_report(spark):
    names = ["Sam", "Berta", "Quentin Longname", "Dorothea"]
    ext = spark.createDataFrame([("r", i, n) for i, n in enumerate(names)], "run_id string, line_no int, name string")
    own = spark.createDataFrame([("r", 0, "Sam", ["Sam"]), ("r", 1, "Berta", ["Berta", "Barta"]), ("r", 2, "Dorothea", ["Dorothea"])], "run_id string, entity int, name string, aliases array<string>")
    rows = reconcile.reconcile(ext, own)
    report = reconcile.report(rows).first()
    assert (report.matches, report.missing, report.unread, report.score_mean) == (3, 1, 0, 0)
    assert sorted((r["first"], r["last"]) for r in reconcile.offset_stretches(rows).collect()) == [(0, 1), (3, 3)]


def observations(frames=12):
    rng = np.random.default_rng(7)
    lengths = [-int(x) for x in rng.permutation(np.arange(60, 260))[:80]]
    rows, first = [], 0
    for f in range(frames):
        first += f % 3 == 2
        for v in range(24):
            seen = v < 20
            rows.append(("r", f, v, seen, lengths[first + v] if seen else None, seen, "UNSUB_WHITE" if (first + v) % 3 else "SUB_BLUE"))
    return rows


SCHEMA = "run_id string, frame_id long, vidx int, appear boolean, length int, len_checked boolean, color string"


def test_tracker_follows_the_shifts(spark):
    log = tracking.track(spark.createDataFrame(observations(), SCHEMA)).orderBy("frame_id").collect()
    assert [r.first_index for r in log] == [(f + 1) // 3 for f in range(12)]
    assert all(r.good for r in log[1:]) and log[0].shown == "A" * 20 + "?" * 4


def test_quick_looks_find_the_same_shifts(spark):
    log = tracking.track(spark.createDataFrame(observations(), SCHEMA), quick=True).orderBy("frame_id").collect()
    assert [r.first_index for r in log] == [(f + 1) // 3 for f in range(12)] and all(r.good for r in log[1:])
    assert log[0].shown == "U" * 20 + "?" * 4 and log[1].shown.count("Q") == 2 and log[1].shown.count("U") == 0
    assert log[2].shown.count("U") == 1 and log[2].shown[19] == "U"  # the one name that has come in
    assert log[1].expected == "L" * 20 + "*" * 4


def test_quick_search_stops_at_two_that_agree():
    slots = {v: tracking.Slot(True) for v in range(6)}
    truth = {v: n for v, n in enumerate([-30, -84, -60, -91, -77, -50])}
    offset, good, looks = tracking.quick_search([-70, -168, -30, -84, None, -91], slots, lambda v, n: truth[v] == n)
    assert (offset, good) == (2, True) and sum(s.how == "quick" for s in slots.values()) == 2 and looks <= 24
    nothing = {v: tracking.Slot(True) for v in range(6)}
    assert tracking.quick_search([-70, None], nothing, lambda v, n: False) == (None, False, 2)


def test_glyphs():
    slot, entity = tracking.Slot, tracking.Entity
    shown = [slot(True, None, True), slot(True, -5, True, how="quick"), slot(True, -5, True, how="unknown"), slot(True, -5, how="match"), slot(True, -5, how="read"), slot(True), slot(False, -5), slot(False)]
    assert "".join(map(tracking.glyph_visible, shown)) == "DQUKGA_?"
    assert "".join(map(tracking.glyph_expected, [entity(name="n", processing=True), entity(processing=True), entity(-5, seen=True), entity(seen=True), entity(-5)])) == "NOLS*"


def test_tracker_ends_a_quiet_run():
    run = tracking.Run()
    told = [tracking.step(run, f, [(0, False, None, False, None)]) for f in range(152)]
    assert told[149]["status"] == "READING" and told[150]["status"] == "COMPLETE" and told[151] is None


def test_stream_and_batch_track_alike(spark, tmp_path):
    rows = observations()
    for part in range(3):
        spark.createDataFrame(rows[part * 96 : part * 96 + 96], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{part}"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = tracker.track_stream(source).writeStream.format("memory").queryName("tracked").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    want = tracking.track(spark.createDataFrame(rows, SCHEMA))
    key = lambda r: r.frame_id
    assert sorted(spark.table("tracked").collect(), key=key) == sorted(want.collect(), key=key)


def png(body: bytes) -> bytes:
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return frames.PNG_SIGNATURE + chunk(b"IDAT", body) + chunk(b"IEND", b"")


def test_images_are_cut_from_chunks(spark):
    jpgs = [b"\xff\xd8" + bytes([i]) * 10 + b"\xff\xd9" for i in range(3)]
    data = b"".join(jpgs)
    chunks = [("s", i, data[i * 9 : i * 9 + 9]) for i in range(5)]
    assert data[:45] == b"".join(c for *_, c in chunks)
    got = frames.cut_images(spark.createDataFrame(chunks, "stream string, seq int, chunk binary")).orderBy("image_no").collect()
    assert [bytes(r.image) for r in got] == jpgs
    pngs = png(b"IEND in a body") + png(b"x")
    cutter = frames.PngCutter()
    out = [x for i in range(0, len(pngs), 5) for x in cutter.push(pngs[i : i + 5])]
    assert out == [(png(b"IEND in a body"), False), (png(b"x"), False)]


def test_what_is_no_image_fails_and_stops_nothing(spark):
    data = b"no png" + png(b"a") + b"\x89PNx" + png(b"b") + b"rest"
    want = [(b"no png", True), (png(b"a"), False), (b"\x89PNx", True), (png(b"b"), False)]
    for size in (1, 7, 1000):
        cutter = frames.PngCutter()
        assert [x for i in range(0, len(data), size) for x in cutter.push(data[i : i + size])] == want
    got = frames.cut_images(spark.createDataFrame([("s", 0, data), ("s", 1, None)], "stream string, seq int, chunk binary"), "png").orderBy("image_no").collect()
    assert [(bytes(r.image), r.failed) for r in got] == want


def test_folders_and_lists(spark, tmp_path):
    for name in ("2.png", "10.png", "notes.txt"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "1.png").write_bytes(b"x")
    got = frames.frame_folder(spark, str(tmp_path), 2).collect()
    assert [r.frame_no for r in got] == [2, 10]
    (tmp_path / "list").write_bytes(b"title\r\na\r\nb\n")
    assert [tuple(r) for r in frames.name_list(spark, str(tmp_path / "list"), 1).collect()] == [(0, "a"), (1, "b")]


HOCR = """<html xmlns="http://www.w3.org/1999/xhtml"><body><div><div><p>
<span title="bbox 1 2 30 40; baseline 0"><span title="bbox 1 2 3 4; x_wconf 60"><span title="x_bboxes 1; x_conf 99">A</span><span title="x_bboxes 1; x_conf 98">b</span></span></span>
</p></div></div></body></html>"""


def test_hocr(spark):
    r = frames.parse_hocr(spark.createDataFrame([("j", HOCR), ("k", None)], "job_id string, xml string")).collect()
    assert len(r) == 1 and (r[0].text, r[0].x0, r[0].y1) == ("Ab", 1, 40)
    assert r[0].confidence == pytest.approx(197 / 2.6)


def test_pages_that_cannot_be_read(spark):
    bad = ["<html", "<html><body><div><div><p><span/></p></div></div></body></html>", HOCR.replace("x_wconf 60", "x_wconf high"), HOCR.replace("bbox 1 2 30 40", "bbox 1")]
    got = frames.parse_hocr(spark.createDataFrame([*((f"b{i}", x) for i, x in enumerate(bad)), ("j", HOCR), ("e", "<html><body/></html>")], "job_id string, xml string")).collect()
    assert sorted((r.job_id, r.failed, r.text) for r in got) == [*((f"b{i}", True, None) for i in range(4)), ("j", False, "Ab")]


def test_settings(spark, tmp_path):
    defaults = {"core": {"fps": 30, "ocr": None}, "debug": {"process": False}}
    assert frames.settings(spark, str(tmp_path / "none.json"), defaults) == defaults
    (tmp_path / "own.json").write_text('{"core": {"fps": 60, "other": 1, "ocr": "native"}, "debug": null}')
    assert frames.settings(spark, str(tmp_path / "own.json"), defaults) == {"core": {"fps": 60, "ocr": "native"}, "debug": {"process": False}}


def frame(lengths, rounded=0):
    """A raster with a box of a bright edge for each length; the upper edge may begin some pixels inside."""
    image = np.full((1080, 1920, 3), 60, np.uint8)
    for slot, length in enumerate(lengths):
        y, x = images.TOP + images.HEIGHT * slot, images.RIGHT + length
        image[y, x + rounded : images.RIGHT + 1] = 200
        image[y + bool(rounded) : y + 40, x] = 200
        image[y : y + 40, images.RIGHT] = 200
    return image


def test_observed_lengths(spark):
    lengths = [-100, -150, -220]
    image = frame(lengths)
    df = spark.createDataFrame([("r", 1, 1920, 1080, 3, image.tobytes())], "run_id string, frame_id long, width int, height int, channels int, data binary")
    got = images.observe(df).orderBy("vidx").collect()
    assert [r.appear for r in got[:5]] == [True, True, True, False, False] and len(got) == 24
    right = images.line_mask(image, 1)
    assert images.quick_length(right, 1, -150) == -150 and images.quick_length(right, 1, -120) is None
    assert all(abs(r.length - n) <= 2 for r, n in zip(got, lengths, strict=False) if r.length is not None)


def test_quick_looks_at_all_columns_are_those_at_each():
    right = images.line_mask(frame([-100, -150, -220, -90]), 1)
    noisy = np.random.default_rng(3).random(right.shape) < 0.7
    for mask in (right, noisy, right[:1070], right[:400]):
        for slot in range(images.SLOTS):
            assert images.quick_lengths(mask, slot) == [n for n in range(-images.RIGHT, 1) if images.quick_length(mask, slot, n) is not None]


def test_frames_are_tracked_by_quick_looks_at_their_pixels(spark):
    """Names move up by one in every second frame; the offsets come from looks at pixels, not from what a slot's length is said to be."""
    names = [-int(x) for x in np.random.default_rng(6).permutation(np.arange(80, 280, 7))[:22]]
    data = [("r", f, 1920, 1080, 3, frame(names[f // 2 : f // 2 + 12], 6).tobytes()) for f in range(8)]
    df = spark.createDataFrame(data, "run_id string, frame_id long, width int, height int, channels int, data binary").repartition(4)
    seen = images.observe(df, looks=True)
    assert all(r.length in r.looks for r in seen.where("appear").collect()) and seen.where("appear").count() == 96
    log = tracking.track(seen, quick=True).orderBy("frame_id").collect()
    assert [r.first_index for r in log] == [f // 2 for f in range(8)] and all(r.good for r in log[1:])
    assert log[1].shown.count("Q") == 2 and log[1].shown.count("U") == 0
    # Without a look that hits there is nothing to agree on.
    blind = tracking.track(seen.withColumn("looks", F.array().cast("array<int>")), quick=True).orderBy("frame_id").collect()
    assert not any(r.good for r in blind[1:])


def test_templates_floods_and_crops():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 255, (60, 80, 3), np.uint8)
    assert images.template_matches(image, image[10:30, 20:50], 20, 10)
    assert not images.template_matches(image, image[10:30, 20:50], 5, 5)
    name = np.full((40, 200, 3), 30, np.uint8)
    name[15:25, 50:60] = (245, 246, 244)
    out, color = images.binarise(name)
    # All within three steps of the name's pixels are painted.
    assert color == "UNSUB_WHITE" and (out[15:25, 50:60] == 0).all() and (out[12:28, 47:63] != 255).all() and (out != 255).sum() == 16 * 16
    crop = images.name_crop(2, -200)
    assert (crop.x, crop.y, crop.w, crop.h) == (1694 - 200 + 4, 125 + 80, 200 - 42 - 4, 40)
    assert len(images.pixel_differences(name, name)) == 0
    mean, _, least, most = images.principal_box(np.array([[0, 0, 0], [2, 0, 0], [0, 4, 0], [2, 4, 0]], float))
    assert mean.tolist() == [1, 2, 0] and np.allclose(sorted(most - least), [0, 2, 4])


def test_names_are_read_from_their_slots(spark):
    image = frame([-200] * 3)
    image[images.TOP + 13 : images.TOP + 27, images.RIGHT - 140 : images.RIGHT - 120] = (245, 246, 244)
    jobs = spark.createDataFrame([("r", 5, 1, 0, -200, 1920, 1080, 3, image.tobytes())], JOBS)
    for kind, want in enumerate(([("Name", 80.0, False)], [(None, images.UNREAD, False)], [])):
        assert [(r.text, r.confidence, r.failed) for r in images.read_slots(jobs, _answering(kind)).collect()] == want
    more = [("r", 6, 1, 1, None, 1920, 1080, 3, image.tobytes()), ("r", 7, 1, 2, -30, 1920, 1080, 3, image.tobytes())]
    got = {r.user_idx: r for r in images.read_slots(spark.createDataFrame(more, JOBS), _answering(0)).collect()}
    assert (got[6].text, got[6].confidence, got[6].failed) == (None, images.UNTRIED, False) and got[7].failed
    assert bytes(got[6].image).startswith(frames.PNG_SIGNATURE)


def test_kernels_over_frames(spark):
    rng = np.random.default_rng(3)
    image = rng.integers(0, 255, (1080, 1920, 3), np.uint8)
    other = image.copy()
    other[144, 1839] = 255
    image[144, 1839] = 0
    df = spark.createDataFrame([("r", i, 1920, 1080, 3, x.tobytes()) for i, x in enumerate((image, other))], "run_id string, frame_id long, width int, height int, channels int, data binary")
    assert sorted((r.frame_id, r.covered) for r in images.chat_covered(df).collect()) == [(0, True), (1, False)]
    own = [(image[100:120, 200:230].copy(), 200, 100, 0.8), (image[:9, :9].copy(), 700, 700, 0.85)]
    assert [r.ready for r in images.screens(df, own).collect()] == [True, True] and [r.ready for r in images.screens(df, own[1:]).collect()] == [False, False]
    pairs = spark.createDataFrame([(9, 1920, 1080, 3, image.tobytes(), other.tobytes())], "pair_id long, width int, height int, channels int, a binary, b binary")
    assert [tuple(r) for r in images.differing_pixels(pairs).collect()] == [(9, 1839, 144)]
    name = np.full((40, 90, 3), 30, np.uint8)
    name[15:25, 50:60] = (122, 146, 228)
    got = images.binarised(spark.createDataFrame([("r", 1, 90, 40, 3, name.tobytes())], "run_id string, user_idx int, width int, height int, channels int, data binary")).first()
    assert got.color == "SUB_BLUE" and bytes(got.grey) == images.binarise(name)[0].tobytes()


def test_boxes_of_points_along_their_axes(spark):
    rng = np.random.default_rng(4)
    data = [(k, *(float(x) for x in rng.normal(size=3) * (1, 5, 20) + 100)) for k in (0, 1) for _ in range(200)]
    df = spark.createDataFrame(data, "k int, r double, g double, b double")
    for row in images.principal_boxes(df, ["k"], ("r", "g", "b")).collect():
        points = np.array([x[1:] for x in data if x[0] == row.k])
        mean, axes, least, most = images.principal_box(points)
        assert np.allclose(row["mean"], mean) and np.allclose(np.abs(np.sum(np.array(row.axes) * axes, axis=1)), 1)
        assert np.allclose(np.array(row.most) - np.array(row.least), most - least)


def test_pictures_lines_and_numbers(spark, tmp_path):
    rng = np.random.default_rng(5)
    image = rng.integers(0, 255, (20, 30, 3), np.uint8)
    (tmp_path / "1.png").write_bytes(images.encoded(image))
    r = frames.decoded_images(spark, str(tmp_path)).first()
    assert (np.frombuffer(r.data, np.uint8).reshape(20, 30, 3)[:, :, ::-1] == image).all() and images.encoded(image, "raw") == image.tobytes()
    assert (images.widened(image, 30) == image).all() and images.widened(image, 60).shape == (40, 60, 3) and images.widened(image[:, :, 0], 15).shape == (10, 15)
    plain = np.full((5, 9, 3), 50, np.uint8)
    plain[:, 4] = 220
    assert np.flatnonzero(images.white_lines(plain, 1)[2]).tolist() == [4] == np.flatnonzero(images.white_lines(plain, -1)[2]).tolist()


JOBS = "run_id string, user_idx int, frame_id long, slot int, length int, width int, height int, channels int, data binary"


def _answering(kind):
    """A recogniser that says the same of every picture."""
    said = [[("ab", 99.0), (" Name ", 80.0)], [], [("abc", 90.0)]][kind]
    return lambda data: said


def painted_by_search(seeds, hits, expand):
    """From each seed on, one pixel after the other."""
    def around(at, n):
        y, x = at
        return {(v, u) for v in range(max(0, y - n), min(hits.shape[0], y + n + 1)) for u in range(max(0, x - n), min(hits.shape[1], x + n + 1))}

    joined, left = set(), [tuple(p) for p in np.argwhere(seeds & hits).tolist()]
    while left:
        at = left.pop()
        if at not in joined:
            joined.add(at)
            left += [q for q in around(at, expand + 1) if hits[q]]
    return {q for at in joined for q in around(at, expand)}


def test_what_is_painted_hangs_together_with_a_seed():
    rng = np.random.default_rng(6)
    for expand in (0, 1, 3):
        hits = rng.random((30, 60)) < 0.03
        seeds = np.zeros_like(hits)
        seeds[:, 50:] = True
        assert {tuple(p) for p in np.argwhere(images.grown(seeds, hits, expand)).tolist()} == painted_by_search(seeds, hits, expand)
    assert images.binarise(np.full((40, 60, 3), 30, np.uint8))[1] is None


def test_a_failing_recogniser_stops_nothing(spark):
    def recognise(image):
        if image == b"bad":
            raise RuntimeError
        return image.decode(), 90.0

    df = spark.createDataFrame([("r", 0, b"bad"), ("r", 1, b"Name")], "run_id string, user_idx int, image binary")
    assert sorted((r.user_idx, r.text, r.failed) for r in images.read_names(df, recognise).collect()) == [(0, None, True), (1, "Name", False)]


def test_sinks(spark, tmp_path):
    log = tracking.track(spark.createDataFrame(observations(2), SCHEMA))
    sinks.write_log(log, str(tmp_path / "log"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "log")).collect())
    assert text.count("seen  ") == 2 and text.count("expected ") == 2
    row = spark.range(1).select(sinks.entity_json(F.lit("n"), F.lit(-5), F.lit(1), F.lit(2.0), F.array(F.lit("n")), F.lit(3), F.lit(10), F.lit(0)).alias("j"))
    assert '"timeOnScreen":7.0' in row.first().j


def comparable(rows):
    """Rows by name of column, whole numbers and floats alike, in an order of their own."""
    def plain(x):
        return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else x.isoformat() if hasattr(x, "isoformat") else x

    return sorted((tuple(plain(r[c]) for c in sorted(r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_queries_give_what_their_sql_gives(spark, name):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("nation", "customer", "documents", "part", "orders", "lineitem", "events", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    want = con.sql(catalog.SQL[name])
    names = want.columns
    got = catalog.QUERIES[name](spark, d)
    assert sorted(got.columns) == sorted(names)
    assert comparable(r.asDict() for r in got.collect()) == comparable(dict(zip(names, r, strict=True)) for r in want.fetchall())
