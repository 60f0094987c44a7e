"""A recorded stream of images, replayed: a Spark data source whose offsets are bytes.

    spark.dataSource.register(replay.ImageReplay)
    spark.readStream.format("image_replay").option("form", "jpg").load("/recordings/run")

The path is a file, or a folder of files that are one stream in the order of their numbers and may still be growing.  An offset is where an
image ends, and how many have ended before; what follows the last end waits for the rest of its image, in this query or after a restart.  Options: form (jpg or png); stream (the stream's name, by default the
path); partitions (of a batch, 4); fps and begun (seconds of the epoch): images are due at so many a second from then on, which doesn't depend on when a query is started again.
The driver reads new bytes once, a block at a time, to find where images end; tasks read the images, each its own stretch.  A started query
finds its place by reading from the beginning, keeping nothing.
"""

from __future__ import annotations

import math
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tallyloom.sources.frames import CUTTERS, FRAMES

#: Bytes that are read at once.
BLOCK = 1 << 20


class Recording:
    """The files of a path as one sequence of bytes."""

    def __init__(self, path: str) -> None:
        self.files, self.root = fs.FileSystem.from_uri(path)

    def parts(self) -> list[tuple[str, int]]:
        """(file, size) in order."""
        root = self.files.get_file_info(self.root)
        if root.type == fs.FileType.File:
            return [(root.path, root.size)]
        held = [f for f in self.files.get_file_info(fs.FileSelector(self.root)) if f.type == fs.FileType.File and re.search(r"\d", f.base_name)]
        return [(f.path, f.size) for f in sorted(held, key=lambda f: ([int(x) for x in re.findall(r"\d+", f.base_name)], f.base_name))]

    def blocks(self, at: int, stop: int | None = None) -> Iterator[bytes]:
        """The bytes from *at* to *stop*, or to the end of what is there."""
        begin = 0
        for path, size in self.parts():
            first, last = max(at, begin), begin + size if stop is None else min(stop, begin + size)
            if first < last:
                with self.files.open_input_file(path) as f:
                    f.seek(first - begin)
                    while first < last and (block := f.read(min(BLOCK, last - first))):
                        yield block
                        first += len(block)
            begin += size


def ends(recording: Recording, form: str, at: int, most: float = math.inf, stop: int | None = None) -> Iterator[int]:
    """Where images end, from an end at *at* on, *most* of them."""
    cutter = CUTTERS[form]()
    for block in recording.blocks(at, stop):
        for image, _ in cutter.push(block):
            if most <= 0:
                return
            most, at = most - 1, at + len(image)
            yield at
        if most <= 0:
            return


@dataclass
class Stretch(InputPartition):
    """Some images, one after the other: the first one's number and their bytes."""

    first: int
    start: int
    stop: int


class ReplayReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.recording, self.form = Recording(options["path"]), options.get("form", "jpg")
        self.stream, self.count = options.get("stream", options["path"]), int(options.get("partitions", 4))
        self.fps, self.begun = float(options.get("fps", "inf")), float(options.get("begun", 0))
        if self.form not in CUTTERS:
            raise ValueError(f"form must be one of {sorted(CUTTERS)}")
        if not math.isinf(self.fps) and not self.begun:
            raise ValueError("images a second count from a time, begun")
        self.at = self.initialOffset()

    def initialOffset(self) -> dict:  # noqa: N802
        return {"byte": 0, "images": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        due = math.inf if math.isinf(self.fps) else math.floor((time.time() - self.begun) * self.fps)
        for end in ends(self.recording, self.form, self.at["byte"], due - self.at["images"]):
            self.at = {"byte": end, "images": self.at["images"] + 1}
        return self.at

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        found = [start["byte"], *ends(self.recording, self.form, start["byte"], stop=end["byte"])]
        if found[-1] < end["byte"]:
            # Bytes that are no image end where the next one begins, which is beyond.
            found.append(end["byte"])
        step = max(1, math.ceil((len(found) - 1) / self.count))
        return [Stretch(start["images"] + i, found[i], found[min(i + step, len(found) - 1)]) for i in range(0, len(found) - 1, step)]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        cutter, number = CUTTERS[self.form](), partition.first
        for block in self.recording.blocks(partition.start, partition.stop):
            for image, failed in cutter.push(block):
                yield self.stream, number, image, failed
                number += 1
        if cutter.rest:
            yield self.stream, number, cutter.rest, True

    def commit(self, end: dict) -> None:
        """Nothing is kept for a batch."""


class ImageReplay(DataSource):
    """(stream, image_no, image, failed), as sources.frames.cut_images gives of the whole."""

    @classmethod
    def name(cls) -> str:
        return "image_replay"

    def schema(self) -> str:
        return FRAMES

    def streamReader(self, schema) -> ReplayReader:  # noqa: N802
        return ReplayReader(dict(self.options))
