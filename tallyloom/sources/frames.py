"""Frames and lists as sources: byte streams cut into images, folders of images, lists of names, hOCR, dimensions."""

from __future__ import annotations

import json
import struct
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Marks in image files.
JPG_END = bytes([0xFF, 0xD9])
PNG_SIGNATURE = bytes([137, 80, 78, 71, 13, 10, 26, 10])
PNG_LAST = b"IEND"

FRAMES = "stream string, image_no long, image binary, failed boolean"


class JpgCutter:
    """Cuts a stream after each end mark, also where two chunks share a mark or a chunk ends several images."""

    def __init__(self, rest: bytes = b"", made: int = 0) -> None:
        self.rest, self.made = rest, made

    def push(self, chunk: bytes) -> list[tuple[bytes, bool]]:
        """(image, whether it failed) of all that the chunk ends."""
        self.rest, out, fresh = self.rest + chunk, [], max(0, len(self.rest) - len(JPG_END) + 1)
        while (cut := self.rest.find(JPG_END, fresh)) >= 0:
            cut += len(JPG_END)
            out.append((self.rest[:cut], False))
            self.rest, fresh = self.rest[cut:], 0
        self.made += len(out)
        return out


class PngCutter:
    """Walks a PNG's chunks (length, type, body, check sum) to its last one, over any number of pushed pieces.

    Bytes that are no PNG, up to the next signature, are an image that failed.
    """

    def __init__(self, rest: bytes = b"", made: int = 0) -> None:
        self.rest, self.made = rest, made

    def push(self, chunk: bytes) -> list[tuple[bytes, bool]]:
        """(image, whether it failed) of all that the chunk ends."""
        self.rest += chunk
        out = []
        while (end := self._end()) is not None:
            out.append((self.rest[: abs(end)], end < 0))
            self.rest = self.rest[abs(end) :]
        self.made += len(out)
        return out

    def _end(self) -> int | None:
        """Where the image at the start of what is held ends, if it does; negative where what is no image does."""
        at = len(PNG_SIGNATURE)
        if not self.rest.startswith(PNG_SIGNATURE[: len(self.rest)]):
            next_one = self.rest.find(PNG_SIGNATURE)
            return -next_one if next_one > 0 else None
        while len(self.rest) >= at + 8:
            (length,) = struct.unpack_from(">I", self.rest, at)
            kind, at = self.rest[at + 4 : at + 8], at + 12 + length
            if kind == PNG_LAST and len(self.rest) >= at:
                return at
        return None


CUTTERS = {"jpg": JpgCutter, "png": PngCutter}


def _cut(stream: str, cutter: JpgCutter | PngCutter, rows: pd.DataFrame) -> pd.DataFrame:
    first = cutter.made
    found = [image for chunk in rows.sort_values("seq")["chunk"] if chunk is not None for image in cutter.push(bytes(chunk))]
    out = [(stream, first + i, *image) for i, image in enumerate(found)]
    return pd.DataFrame(out, columns=[c.split()[0] for c in FRAMES.split(", ")]).astype({"image_no": "int64", "failed": "bool"})


def cut_images(chunks: DataFrame, form: str = "jpg") -> DataFrame:
    """Images of each stream.  *chunks*: (stream, seq, chunk binary); a stream is cut in the order of seq.  What follows the last end is no image."""
    return chunks.groupBy("stream").applyInPandas(lambda key, rows: _cut(key[0], CUTTERS[form](), rows), FRAMES)


def timeout(idle_ms: int | None) -> str:
    """How the state of a stream's keys ends: never, or in a query that runs on, after so many milliseconds without a row."""
    return GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout


def cut_image_stream(chunks: DataFrame, form: str = "jpg", idle_ms: int | None = None) -> DataFrame:
    """As cut_images, over a stream of chunks; what is left of a stream is state, with *idle_ms* (see timeout) until it has been idle for so long."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        cutter = CUTTERS[form](*(state.get if state.exists else ()))
        yield _cut(key[0], cutter, pd.concat(list(batches)))
        state.update((cutter.rest, cutter.made))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)

    return chunks.groupBy("stream").applyInPandasWithState(run, FRAMES, "rest binary, made long", "append", timeout(idle_ms))


def _numbered(files: DataFrame, skip_to: int) -> DataFrame:
    number = F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"(\d+)\.", 1).try_cast("long")
    return files.where(~F.col("path").endswith(".txt")).select(number.alias("frame_no"), "path", F.col("content").alias("image")).where(F.col("frame_no") >= skip_to)


def frame_folder(spark: SparkSession, path: str, skip_to: int = 0) -> DataFrame:
    """(frame_no, path, image): files of a folder by the number before their suffix, in its order, without text files."""
    return _numbered(spark.read.format("binaryFile").load(path), skip_to).orderBy("frame_no")


def replayed_folder(spark: SparkSession, path: str, skip_to: int = 0, a_batch: int = 1) -> DataFrame:
    """The files of frame_folder as a stream, *a_batch* of them in each, in the order in which they were written; a trigger of the query paces it."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return _numbered(spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", a_batch).load(path), skip_to)


def settings(spark: SparkSession, path: str, defaults: dict) -> dict:
    """*defaults* with what a JSON file of settings says, group by group; a file that isn't there says nothing, and unknown names are left out."""
    try:
        text = spark.read.text(path, wholetext=True).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        text = None
    said = json.loads(text.value) if text else {}

    def merged(own: dict, new: object) -> dict:
        new = new if isinstance(new, dict) else {}
        return {k: merged(v, new.get(k)) if isinstance(v, dict) else v if new.get(k) is None else new[k] for k, v in own.items()}

    return merged(defaults, said)


def name_list(spark: SparkSession, path: str, skip: int = 0) -> DataFrame:
    """(line_no, name) of a text file, with either line end; a list is one small file and is read whole."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "name"))
    return lines.where((F.col("line_no") >= skip) & (F.col("name") != "")).withColumn("line_no", F.col("line_no") - skip)


def color_boxes(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file of named boxes, as it is."""
    return spark.read.json(path, multiLine=True)


def _number(title: str, field: int, place: int) -> int:
    return int(title.split(";")[field].split()[place])


def hocr_lines(xml: str) -> list[dict]:
    """The lines of an hOCR page: text without spaces, box, confidence and the mean of the letters' over 1.3."""
    root = ET.fromstring(xml)
    for node in root.iter():
        node.tag = node.tag.rpartition("}")[2]
    out = []
    for line in root.findall("./body/div/div/p/span"):
        box = [_number(line.get("title"), 0, i) for i in range(1, 5)]
        text, word, letters = "", 0, []
        for w in line.findall("span"):
            word = _number(w.get("title"), 1, 1)
            for c in w.findall("span"):
                text += c.text or ""
                letters.append(_number(c.get("title"), 1, 1))
        mean = sum(letters) / (len(letters) * 1.3) if letters else None
        out.append({"text": text, "x0": box[0], "y0": box[1], "x1": box[2], "y1": box[3], "confidence": float(max(word, mean or 0)), "char_conf_avg": mean})
    return out


HOCR = "job_id string, line_no int, text string, x0 int, y0 int, x1 int, y1 int, confidence double, char_conf_avg double, failed boolean"


def parse_hocr(pages: DataFrame) -> DataFrame:
    """Lines of each page.  *pages*: (job_id, xml).  A page that can't be read gives one row with only *failed*; a null page none."""
    columns = [c.split()[0] for c in HOCR.split(", ")]
    kinds = dict.fromkeys(("line_no", "x0", "y0", "x1", "y1"), "Int32") | dict.fromkeys(("confidence", "char_conf_avg"), "Float64") | {"failed": "bool"}

    def lines(job: str, xml: str) -> list[dict]:
        try:
            return [{"job_id": job, "line_no": i, **x, "failed": False} for i, x in enumerate(hocr_lines(xml))]
        except (ET.ParseError, AttributeError, IndexError, ValueError):  # no XML, a line without a title, a field that is short or no number
            return [{"job_id": job, "failed": True}]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [[x.get(c) for c in columns] for job, xml in zip(batch["job_id"], batch["xml"], strict=True) if xml for x in lines(job, xml)]
            yield pd.DataFrame(rows, columns=columns, dtype=object).astype(kinds)

    return pages.select("job_id", "xml").mapInPandas(run, HOCR)


def byte_frames(docs: DataFrame, id_col: str, text_col: str, mark: str) -> DataFrame:
    """(id, frame_no, frame): a text cut after every mark, what follows the last being no frame."""
    parts = F.split(F.col(text_col), mark, -1)
    whole = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.concat(p, F.lit(mark)))
    return docs.select(id_col, F.posexplode(whole).alias("frame_no", "frame"))


def decoded_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, channels, data) of image files, as the JVM decodes them: rows of blue, green, red (and alpha)."""
    image = spark.read.format("image").load(path).select("image.*")
    return image.select(F.col("origin").alias("path"), "width", "height", F.col("nChannels").alias("channels"), "data")
