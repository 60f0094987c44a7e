"""A recording that is replayed gives the images of the batch cutter, also when it grows and the query is started again in the middle of an image."""

import random
import time

import pytest

from tallyloom.sources import frames, replay
from tests.test_operators import png


def jpgs(n):
    rng = random.Random(n)
    return [b"\xff\xd8" + bytes(rng.randrange(255) for _ in range(rng.randint(1, 400))) + b"\xff\xd9" for _ in range(n)]


def written(folder, data, sizes):
    at = 0
    for i, size in enumerate(sizes):
        (folder / f"part{i}.bin").write_bytes(data[at : at + size])
        at += size
    return at


def run(spark, path, tmp, name, **options):
    stream = spark.readStream.format("image_replay").options(**options).load(str(path))
    query = stream.writeStream.format("parquet").option("path", str(tmp / f"{name}_out")).option("checkpointLocation", str(tmp / f"{name}_ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return sorted((r.stream, r.image_no, bytes(r.image), r.failed) for r in spark.read.schema(frames.FRAMES).parquet(str(tmp / f"{name}_out")).collect())


@pytest.mark.parametrize("form", ["jpg", "png"])
def test_the_images_of_the_batch_also_after_a_restart(spark, tmp_path, form):
    spark.dataSource.register(replay.ImageReplay)
    images = jpgs(40) if form == "jpg" else [png(bytes([i]) * 30) for i in range(6)] + [b"no image"] + [png(bytes([i]) * 9) for i in range(5)]
    data, folder = b"".join(images), tmp_path / "in"
    folder.mkdir()
    rng = random.Random(3)
    sizes = [rng.randint(1, max(2, len(data) // 12)) for _ in range(11)]
    # Cut in the middle of an image: what is there first is all but the last parts.
    done = written(folder, data, sizes)
    first = run(spark, folder, tmp_path, form, form=form, stream="s")
    (folder / "part11.bin").write_bytes(data[done : done + 3])
    (folder / "part100.bin").write_bytes(data[done + 3 :])
    got = run(spark, folder, tmp_path, form, form=form, stream="s")
    chunks = spark.createDataFrame([("s", i, data[at : at + 50]) for i, at in enumerate(range(0, len(data), 50))], "stream string, seq int, chunk binary")
    want = sorted((r.stream, r.image_no, bytes(r.image), r.failed) for r in frames.cut_images(chunks, form).collect())
    assert got == want and 0 < len(first) < len(got) and first == got[: len(first)]


def test_images_are_due_by_the_clock(tmp_path):
    path = tmp_path / "one.bin"
    path.write_bytes(b"".join(jpgs(30)))
    reader = replay.ReplayReader({"path": str(path), "fps": "10", "begun": str(time.time() - 1.25)})
    offset = reader.latestOffset()
    assert 12 <= offset["images"] <= 16
    again = replay.ReplayReader({"path": str(path), "fps": "10", "begun": str(time.time() - 100)})
    assert again.latestOffset() == {"byte": path.stat().st_size, "images": 30}
    parts = again.partitions(offset, again.latestOffset())
    assert [x[1] for p in parts for x in again.read(p)] == list(range(offset["images"], 30)) and 1 < len(parts) <= 4
    bad = tmp_path / "bad.bin"
    bad.write_bytes(png(b"1") + b"none" + png(b"2"))
    one = replay.ReplayReader({"path": str(bad), "form": "png", "partitions": "9"})
    upto = {"byte": len(png(b"1")) + 4, "images": 2}
    assert [x[1:] for p in one.partitions(one.initialOffset(), upto) for x in one.read(p)] == [(0, png(b"1"), False), (1, b"none", True)]
    with pytest.raises(ValueError, match="begun"):
        replay.ReplayReader({"path": str(path), "fps": "10"})
    with pytest.raises(ValueError, match="form"):
        replay.ReplayReader({"path": str(path), "form": "gif"})


def test_blocks_end_anywhere(tmp_path, monkeypatch):
    monkeypatch.setattr(replay, "BLOCK", 7)
    images = jpgs(9)
    (tmp_path / "r.bin").write_bytes(b"".join(images) + b"rest")
    reader = replay.ReplayReader({"path": str(tmp_path / "r.bin"), "partitions": "3"})
    assert [x[2] for p in reader.partitions(reader.initialOffset(), reader.latestOffset()) for x in reader.read(p)] == images
