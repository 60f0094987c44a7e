"""Predicates and kernels over rasters of frames, as numpy arrays of (height, width, channels).

A frame is a row; kernels run by Arrow batch, whole arrays at a time where order doesn't matter.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.color import BOXES, FARTHEST

# Where names are on a raster of 1920 by 1080.
TOP, RIGHT, HEIGHT, SLOTS = 125, 1694, 40, 24
BEFORE_PLAY = 1652
#: The last slot is cut off by the raster's edge and needs fewer hits.
LAST = SLOTS - 1

# A line is so much brighter than the plane behind it, which is at most so bright.
PLANE_MOST, LINE_OVER_PLANE, CLAMP_STEP, CLAMP_LEFT = 180, 65, 150, 30


def raster(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, channels)


def line_mask(image: np.ndarray, side: int, skip: int = 2) -> np.ndarray:
    """Which pixels are a line before a darker plane *skip* pixels to one side (-1 left, 1 right)."""
    rgb = image[:, :, :3].astype(np.int16)
    plane = np.roll(rgb, -side * skip, axis=1)
    dark = plane.sum(axis=2) <= PLANE_MOST * 3
    over = (rgb - plane).sum(axis=2) > LINE_OVER_PLANE * 3
    clamped = (np.minimum(plane + CLAMP_STEP, 255) - plane).sum(axis=2) < CLAMP_LEFT * 3
    mask = dark & (over | clamped)
    if side > 0:
        mask[:, image.shape[1] - skip :] = False
    else:
        mask[:, :skip] = False
    return mask


def _column(mask: np.ndarray, x: int, rows: range) -> int:
    """Hits of a column in the rows that the raster has."""
    if not 0 <= x < mask.shape[1]:
        return 0
    return int(mask[max(rows.start, 0) : min(rows.stop, mask.shape[0]), x].sum())


def _any(mask: np.ndarray, y: int, xs: range) -> bool:
    return 0 <= y < mask.shape[0] and any(0 <= x < mask.shape[1] and mask[y, x] for x in xs)


def appears(left: np.ndarray, slot: int) -> bool:
    y = TOP + HEIGHT * slot
    return _column(left, RIGHT, range(y + 11, y + 31)) > (9 if slot == LAST else 13)


def quick_length(right: np.ndarray, slot: int, length: int) -> int | None:
    """The length if the left edge of the name is there, else None."""
    y, x = TOP + HEIGHT * slot, RIGHT + length
    least = 9 if slot == LAST else 17
    corner = y + HEIGHT // 10
    if _column(right, x, range(y + 10, y + 30)) >= least and corner < x and _any(right, corner, range(x, x + 6)):
        return length
    return None


def quick_lengths(right: np.ndarray, slot: int) -> list[int]:
    """All lengths that a quick look would find, the longest name first; all columns at once."""
    y, least = TOP + HEIGHT * slot, 9 if slot == LAST else 17
    corner = y + HEIGHT // 10
    if corner >= len(right):
        return []
    width = min(RIGHT + 1, right.shape[1])
    hits = right[y + 10 : y + 30, :width].sum(axis=0) >= least
    edge = np.concatenate(([0], np.cumsum(right[corner])))
    x = np.arange(width)
    upper = edge[np.minimum(x + 6, right.shape[1])] > edge[x]
    return (np.flatnonzero(hits & upper & (x > corner)) - RIGHT).tolist()


def follow_line(image: np.ndarray, x: int, y: int, most_fails: int = 2) -> int:
    """How far left the bright line at y goes: the x at which a second pixel fails."""
    line, below = image[y, : x + 1, :3].astype(np.int64), image[y + 1, : x + 1, :3].astype(np.int64)
    darker = (line.sum(axis=1) < below.sum(axis=1)).astype(int)
    dull = ((line.sum(axis=1) < 145 * 3) & (line[:, 2] < 145)).astype(int)
    fails = np.cumsum((darker + dull)[::-1])
    at = np.searchsorted(fails, most_fails)
    return x - int(at) - 1


def name_length(image: np.ndarray, right: np.ndarray, slot: int) -> int | None:
    """The length of a name by its box's left edge, negative, or None."""
    y = TOP + HEIGHT * slot
    if y + 1 >= image.shape[0]:
        return None
    end = follow_line(image, RIGHT - 20, y)
    for x in range(end - 2, end - 9, -1):
        if _column(right, x, range(y + 11, y + 31)) > (6 if slot == LAST else 10):
            corners = range(end - 11, end + 3)
            both = _any(right, y + 4, corners) and (slot == LAST or _any(right, y + 36, corners))
            return x - RIGHT if both else None
    return None


def box_hits(pixels: np.ndarray, name: str, scale: float = 1.0) -> np.ndarray:
    """Which colours are in a colour box."""
    center, sides = (np.array(x, np.float64) for x in BOXES[name])
    return (np.abs(center - pixels[..., :3]) / scale <= sides / 2).all(axis=-1)


def slot_color(image: np.ndarray, slot: int, limit: int = 13, scale: float = 1.3) -> str | None:
    """The colour that first has *limit* pixels in a patch of the name, column by column from the right."""
    y = TOP + HEIGHT * slot + 7
    patch = image[y : y + 26, RIGHT - 91 : RIGHT - 63].transpose(1, 0, 2)[::-1].reshape(-1, image.shape[2])
    best = None
    for name in ("UNSUB_WHITE", "SUB_BLUE"):
        at = int(np.searchsorted(np.cumsum(box_hits(patch, name, scale)), limit))
        if at < len(patch) and (best is None or at < best[0]):
            best = (at, name)
    return best[1] if best else None


OBSERVED = "run_id string, frame_id long, vidx int, appear boolean, length int, len_checked boolean, color string, looks array<int>"


def observe(frames: DataFrame, lengths: bool = True, colors: bool = True, looks: bool = False) -> DataFrame:
    """A row for each slot of each frame.  *frames*: (run_id, frame_id, width, height, channels, data).

    With *looks* there is also the column looks, the lengths that a quick look at the slot would find, for a tracker that looks for lengths: frames are looked at wherever
    they lie, and the tracker, which has to take a run's frames in order, gets these few numbers.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for f in batch.itertuples():
                image = raster(f.data, f.width, f.height, f.channels)
                left, right = line_mask(image, -1), line_mask(image, 1)
                for slot in range(SLOTS):
                    seen = appears(left, slot)
                    length = name_length(image, right, slot) if seen and lengths else None
                    color = slot_color(image, slot) if seen and colors else None
                    rows.append((f.run_id, f.frame_id, slot, seen, length, seen and lengths, color, quick_lengths(right, slot) if seen and looks else []))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in OBSERVED.split(", ")])
            yield out.astype({"length": "Int32", "vidx": "int32"})

    own = frames.mapInPandas(run, OBSERVED)
    return own if looks else own.drop("looks")


@dataclass(frozen=True)
class Crop:
    x: int
    y: int
    w: int
    h: int


def name_crop(slot: int, length: int, inner: bool = True) -> Crop:
    """Where a name of a (negative) length is; the inner crop leaves the box's border out."""
    pad = RIGHT - BEFORE_PLAY if inner else -7
    x, w = RIGHT + length - (0 if inner else 5), -length - pad
    if w < 294:
        x, w = x + 4, w - 4
    if w < 0:
        raise ValueError("a crop of negative width")
    return Crop(x, TOP + slot * HEIGHT, w, HEIGHT)


def cut(image: np.ndarray, crop: Crop) -> np.ndarray:
    return image[crop.y : crop.y + crop.h, crop.x : crop.x + crop.w]


def chat_covers(image: np.ndarray) -> bool:
    """Whether the chat's mark is not as bright as on a free screen."""
    return int(image[144, 1839, :3].astype(int).sum()) < 220 * 3


def template_matches(image: np.ndarray, template: np.ndarray, x: int, y: int, share: float = 0.7, most_diff: float = 20, least_alpha: int = 200) -> bool:
    """Whether the template is at (x, y), by pixels in a fixed stride: yes once over a twentieth are compared and enough are alike, no at three tenths."""
    h, w = template.shape[:2]
    n = h * w
    step = n // (12 if n % 13 == 0 else 13)
    order = np.arange(n) * step % n if step else np.arange(n)
    _, first = np.unique(order, return_index=True)
    order = order[np.sort(first)]
    own, seen = template.reshape(n, -1)[order].astype(int), image[y : y + h, x : x + w].reshape(n, -1)[order].astype(int)
    opaque = own[:, 3] >= least_alpha if own.shape[1] == 4 else np.ones(len(order), bool)
    alike = opaque & (np.abs(own[:, :3] - seen[:, :3]).sum(axis=1) <= most_diff * 3)
    total, checked, hits = n - np.cumsum(~opaque), np.cumsum(opaque), np.cumsum(alike)
    good = (checked > total * 0.05) & (hits > share * checked)
    over = np.concatenate(([False], checked[:-1] >= total[:-1] * 0.3))
    stop = int(np.argmax(over)) if over.any() else len(order)
    return bool(good[:stop].any())


def any_template(image: np.ndarray, templates: list[tuple[np.ndarray, int, int, float]]) -> bool:
    """Whether any of (template, x, y, share) matches."""
    return any(template_matches(image, t, x, y, share) for t, x, y, share in templates)


def greys(image: np.ndarray, name: str, scale: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Grey of each pixel by its distance from a box's centre, and which pixels are in the box."""
    inside = box_hits(image, name, scale)
    far = np.sqrt(((np.array(BOXES[name][0], np.float64) - image[:, :, :3]) ** 2).sum(axis=2)) / FARTHEST / scale
    return np.floor((1 - (1 - far) ** np.where(inside, 2.0, 2.5)) * 255 + 0.5).astype(np.uint8), inside


def near(mask: np.ndarray, steps: int) -> np.ndarray:
    """The pixels within *steps* of a pixel of the mask, by rows, columns and diagonals."""
    out = mask
    for axis in (0, 1):
        spread = out.copy()
        for k in range(1, steps + 1):
            ahead, behind = [slice(None)] * 2, [slice(None)] * 2
            ahead[axis], behind[axis] = slice(k, None), slice(None, -k)
            spread[tuple(ahead)] |= out[tuple(behind)]
            spread[tuple(behind)] |= out[tuple(ahead)]
        out = spread
    return out


def grown(seeds: np.ndarray, hits: np.ndarray, expand: int = 3) -> np.ndarray:
    """Which pixels are painted: all within *expand* steps of a hit that hangs together with a seed.

    Hits hang together over gaps of at most *expand* pixels.  What is painted doesn't depend on any order of pixels.
    """
    joined = seeds & hits
    while True:
        more = near(joined, expand + 1) & hits
        if (more == joined).all():
            return near(joined, expand)
        joined = more


def binarise(image: np.ndarray, color: str | None = None, scale: float = 1.0, expand: int = 3) -> tuple[np.ndarray, str | None]:
    """(grey raster on white, the colour's name) of a name's crop.

    Scanned in columns from the right, leaving out the border, the first pixel in a colour box gives the name's colour, the first box of several.
    Hits of that colour inside the border are the seeds of what is painted; see :func:`grown`.
    """
    h, w = image.shape[:2]
    out, inner = np.full((h, w), 255, np.uint8), np.zeros((h, w), bool)
    inner[7 : max(7, h - 5), 9 : max(9, w - 2)] = True
    if color is None:
        hits = np.stack([box_hits(image, n, scale) & inner for n in BOXES])
        columns = np.flatnonzero(hits.any(axis=(0, 1)))
        if not len(columns):
            return out, None
        at = hits[:, :, columns[-1]]
        color = list(BOXES)[int(at[:, at.any(axis=0).argmax()].argmax())]
    grey, inside = greys(image, color, scale)
    painted = grown(inside & inner, inside, expand)
    out[painted] = grey[painted]
    return out, color


def pixel_differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(x, y) of the pixels in which two rasters differ."""
    y, x = np.nonzero((a != b).any(axis=2))
    return np.stack([x, y], axis=1)


def principal_box(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(mean, axes as rows, least, most) of points along the axes of their population covariance."""
    mean = points.mean(axis=0)
    _, axes = np.linalg.eigh(np.cov((points - mean).T, bias=True))
    turned = (points - mean) @ axes
    return mean, axes.T, turned.min(axis=0), turned.max(axis=0)


def read_names(crops: DataFrame, recognise, schema: str = "run_id string, user_idx int, text string, confidence double, failed boolean") -> DataFrame:
    """Apply a recogniser (bytes to (text, confidence)) to (run_id, user_idx, image); a failure gives a row and stops nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                try:
                    text, confidence = recognise(bytes(r.image))
                    rows.append((r.run_id, r.user_idx, text, confidence, False))
                except Exception:  # noqa: BLE001  the recogniser is foreign code
                    rows.append((r.run_id, r.user_idx, None, None, True))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return crops.select("run_id", "user_idx", "image").mapInPandas(run, schema)


FRAME = "run_id, frame_id, width, height, channels, data"


def per_frame(frames: DataFrame, kernel: Callable[[np.ndarray], object], name: str, kind: str) -> DataFrame:
    """(run_id, frame_id, *name*): the kernel's answer for every raster of *frames*, one after the other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            told = [kernel(raster(f.data, f.width, f.height, f.channels)) for f in batch.itertuples()]
            yield pd.DataFrame({"run_id": batch["run_id"], "frame_id": batch["frame_id"], name: told})

    return frames.select(*FRAME.split(", ")).mapInPandas(run, f"run_id string, frame_id long, {name} {kind}")


def screens(frames: DataFrame, templates: list[tuple[np.ndarray, int, int, float]]) -> DataFrame:
    """(run_id, frame_id, ready): whether any of (template, x, y, share) is in the frame; templates are few and go with the task."""
    return per_frame(frames, lambda image: any_template(image, templates), "ready", "boolean")


def chat_covered(frames: DataFrame) -> DataFrame:
    """(run_id, frame_id, covered): whether the chat covers names."""
    return per_frame(frames, chat_covers, "covered", "boolean")


def binarised(crops: DataFrame, scale: float = 1.0) -> DataFrame:
    """(run_id, user_idx, width, height, grey, color): *crops* (run_id, user_idx, width, height, channels, data) with names dark on white."""
    schema = "run_id string, user_idx int, width int, height int, grey binary, color string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for c in batch.itertuples():
                grey, color = binarise(raster(c.data, c.width, c.height, c.channels), scale=scale)
                rows.append((c.run_id, c.user_idx, c.width, c.height, grey.tobytes(), color))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return crops.select("run_id", "user_idx", "width", "height", "channels", "data").mapInPandas(run, schema)


def differing_pixels(pairs: DataFrame) -> DataFrame:
    """(pair_id, x, y) of the pixels in which two rasters of one size differ.  *pairs*: (pair_id, width, height, channels, a, b)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p in batch.itertuples():
                at = pixel_differences(*(raster(x, p.width, p.height, p.channels) for x in (p.a, p.b)))
                yield pd.DataFrame({"pair_id": p.pair_id, "x": at[:, 0].astype("int32"), "y": at[:, 1].astype("int32")})

    return pairs.select("pair_id", "width", "height", "channels", "a", "b").mapInPandas(run, "pair_id long, x int, y int")


def principal_boxes(points: DataFrame, keys: list[str], p: tuple[str, str, str]) -> DataFrame:
    """(keys, mean, axes, least, most): of each group's points along the axes of their population covariance, the least spread first.

    Means and covariances are sums that Spark takes in parts; only their nine numbers a group reach Python, and the extent along the axes is a second pass over
    the points.  An axis points to where its largest component is positive.
    """
    kinds = ", ".join(f"{k} {t}" for k, t in points.select(*keys).dtypes)
    pairs = [(a, b) for i, a in enumerate(p) for b in p[i:]]
    sums = points.groupBy(*keys).agg(F.array(*(F.avg(c) for c in p)).alias("mean"), F.array(*(F.covar_pop(a, b) for a, b in pairs)).alias("spread"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            axes = []
            for spread in batch["spread"]:
                full = np.zeros((3, 3))
                full[np.triu_indices(3)] = spread
                _, own = np.linalg.eigh(full + np.triu(full, 1).T)
                axes.append([[float(x) for x in a * np.sign(a[np.abs(a).argmax()])] for a in own.T])
            yield batch.drop(columns="spread").assign(axes=axes)

    turned = sums.mapInPandas(run, f"{kinds}, mean array<double>, axes array<array<double>>")
    met = F.lit(True)
    for k in keys:
        met = met & F.col(f"p.{k}").eqNullSafe(F.col(f"t.{k}"))
    both = points.alias("p").join(turned.alias("t"), met)
    place = F.array(*(sum(((F.col(f"p.{c}") - F.col("t.mean")[i]) * F.col("t.axes")[j][i] for i, c in enumerate(p)), F.lit(0.0)) for j in range(3)))
    own = both.select(*(F.col(f"t.{k}").alias(k) for k in keys), F.col("t.mean").alias("mean"), F.col("t.axes").alias("axes"), place.alias("at"))
    return own.groupBy(*keys, "mean", "axes").agg(F.array(*(F.min(F.col("at")[j]) for j in range(3))).alias("least"), F.array(*(F.max(F.col("at")[j]) for j in range(3))).alias("most"))


def white_lines(image: np.ndarray, side: int, size: int = 1, balance: int = 70, least: int = 140, over: int = 26) -> np.ndarray:
    """The older test for a line: which pixels, with the *size* - 1 before them, are white enough, and brighter than the pixel to one side (-1 left, 1 right)."""
    rgb = image[:, :, :3].astype(np.float64)
    line = sum((np.roll(rgb, side * k, axis=1) for k in range(1, size)), rgb) / size
    r, g, b = np.moveaxis(line, 2, 0)
    uneven = (np.abs(r - g) + np.abs(g - b) + np.abs(r - b)) / 3
    beside = np.abs(line - np.roll(rgb, -side, axis=1)).sum(axis=2)
    out = (uneven <= balance) & (line.sum(axis=2) >= least * 3) & (beside > over)
    edge = np.zeros_like(out)
    edge[:, size - 1 : -1] = True
    return out & (edge if side > 0 else edge[:, ::-1])


def encoded(image: np.ndarray, form: str = "png") -> bytes:
    """A raster as a PNG, of grey, colours or colours with alpha, or as its bare bytes ("raw")."""
    if form == "raw":
        return image.tobytes()
    h, w = image.shape[:2]
    kind = {1: 0, 3: 2, 4: 6}[image.shape[2] if image.ndim == 3 else 1]
    lines = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, -1)], axis=1)

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    head = struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def widened(image: np.ndarray, width: int = 400) -> np.ndarray:
    """The raster at another width, each pixel being the mean of the four around its place by their nearness."""
    h, w = image.shape[:2]
    height = max(1, round(h * width / w))
    y, x = ((np.arange(n) + 0.5) * m / n - 0.5 for n, m in ((height, h), (width, w)))
    y, x = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    dy, dx = ((v - v0).reshape(shape) for v, v0, shape in ((y, y0, (-1, 1) + (1,) * (image.ndim - 2)), (x, x0, (1, -1) + (1,) * (image.ndim - 2))))
    own = image.astype(np.float64)
    top = own[y0][:, x0] * (1 - dx) + own[y0][:, x1] * dx
    low = own[y1][:, x0] * (1 - dx) + own[y1][:, x1] * dx
    return np.floor(top * (1 - dy) + low * dy + 0.5).astype(np.uint8)


#: Confidences of an image that is kept without a text: nothing was read, or nothing was tried.
UNREAD, UNTRIED = 11.1, -1.0
#: The length at which an image is taken where none is known.
BASIC_LENGTH = -300


def read_slots(jobs: DataFrame, recognise: Callable[[bytes], list[tuple[str, float]]], least_chars: int = 4) -> DataFrame:
    """Read names from their slots: crop, binarise, widen, recognise, and keep the image that shows it.

    *jobs*: (run_id, user_idx, frame_id, slot, length, width, height, channels, data), one row a name to read; *recognise*: a PNG to lines (text, confidence).
    Gives (run_id, user_idx, frame_id, text, confidence, image, failed): the first line of at least *least_chars* characters, trimmed; without a line a null text with the
    confidence UNREAD; with only shorter ones no row; where no length is known, the image at BASIC_LENGTH with UNTRIED.  What can't be cropped or read has *failed*, and stops nothing.
    """
    schema = "run_id string, user_idx int, frame_id long, text string, confidence double, image binary, failed boolean"

    def read(j) -> tuple | None:
        image = raster(j.data, j.width, j.height, j.channels)
        if pd.isna(j.length):
            return None, UNTRIED, encoded(cut(image, name_crop(j.slot, BASIC_LENGTH))), False
        length = int(j.length)
        grey, _ = binarise(cut(image, name_crop(j.slot, length)))
        lines = recognise(encoded(widened(grey)))
        shown = encoded(cut(image, name_crop(j.slot, length, inner=False)))
        if not lines:
            return None, UNREAD, shown, False
        first = next(((t, c) for t, c in lines if len(t) >= least_chars), None)
        return first and (first[0].strip(), float(first[1]), shown, False)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for j in batch.itertuples():
                try:
                    told = read(j)
                except Exception:  # noqa: BLE001  the recogniser is foreign code, and a length may not fit its frame
                    told = None, None, None, True
                if told:
                    rows.append((j.run_id, j.user_idx, j.frame_id, *told))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return jobs.select("run_id", "user_idx", "frame_id", "slot", "length", "width", "height", "channels", "data").mapInPandas(run, schema)
