"""Small scalar functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units of time and how many of each make the next.
UNITS = (("ms", 1000), ("s", 60), ("m", 60), ("h", 60), ("d", 24), ("w", 7))


def to_percent(x: Column) -> Column:
    """A share as a percentage of two decimals."""
    return F.format_string("%.2f%%", x.cast("double") * 100)


def in_open_range(x: Column, source: Column, width: float) -> Column:
    """Whether x lies strictly within *width* of *source*."""
    return (x > source - width) & (x < source + width)


def coordinate_hash(x: Column, y: Column) -> Column:
    return x * 2000 + y


def pixel_offset(x: Column, y: Column, width: int, channels: int) -> Column:
    """Place of a pixel's first byte in a flat raster."""
    return (y * width + x) * channels


def pixel_at(offset: Column, width: int, channels: int) -> tuple[Column, Column]:
    """(x, y) of the pixel that holds a byte."""
    pixel = F.floor(offset / channels)
    return pixel % width, F.floor(pixel / width)


def scaled_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, basis: tuple[int, int] = (1920, 1080)) -> Column:
    """A box measured on the basis raster, on one of another size: corners down, sizes up."""
    return F.struct(F.floor(x * width / basis[0]).alias("x"), F.floor(y * height / basis[1]).alias("y"), F.ceil(w * width / basis[0]).alias("w"), F.ceil(h * height / basis[1]).alias("h"))


def duration_text(ms: Column, many: bool = True, decimals: int = 2) -> Column:
    """Milliseconds in readable units: all of them from the largest, without zeros, or one with decimals.

    Beyond seven of the last unit that unit is told twice: how many sevens, and at the end what is left of them.
    """
    value, text, done, unit = ms.cast("double"), F.lit(""), F.lit(None).cast("string"), ""

    def told(value: Column, unit: str, text: Column) -> Column:
        return F.concat(F.floor(value).cast("long").cast("string"), F.lit(unit), text) if many else F.concat(F.format_string(f"%.{decimals}f", value), F.lit(unit))

    for unit, size in UNITS:
        done = F.when(done.isNotNull(), done).when(value < size, told(value, unit, text))
        whole = F.floor(value % size).cast("long")
        text = F.concat(text, F.when(whole == 0, F.lit("")).otherwise(F.concat(F.lit(" "), whole.cast("string"), F.lit(unit))))
        value = value / size
    return F.coalesce(done, told(value, unit, text))


def half_open(end: int, start: int = 0, step: int = 1) -> Column:
    """Array from start to end without end, in whichever direction that is."""
    n = max(0, -(-abs(end - start) // abs(step)))
    sign = 1 if end >= start else -1
    return F.array(*(F.lit(start + sign * abs(step) * i) for i in range(n)))


def reversed_half_open(start: int, end: int = 0) -> Column:
    """half_open of the two, from its other end: without the first number and with the last, counted the other way."""
    sign = 1 if end >= start else -1
    first = start + (1 if sign > 0 else -1)
    values = list(range(first, end + sign, sign)) if start != end else []
    return F.array(*(F.lit(v) for v in values)).cast("array<int>")


def non_zero(m: Column) -> Column:
    """A map without its zeros."""
    return F.map_filter(m, lambda _, v: v != 0)


def last_n(a: Column, n: int) -> Column:
    """The last n of an array, or all of a shorter one."""
    return F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), F.lit(n))


# Frames after its entry, at 30 a second, at which a name begins to leave the screen and has left it.
LEAVES, LEFT, AT_FPS = 147, 154, 30


def exit_times(entered: Column, fps: float = AT_FPS) -> Column:
    """(leaves, left): frames at which a name is expected to leave; null if it wasn't seen to enter, or did so at frame 0."""
    known = F.when(entered != 0, entered)
    return F.struct((known + LEAVES * AT_FPS / fps).alias("leaves"), (known + LEFT * AT_FPS / fps).alias("left"))


def on_screen(entered: Column, frame: Column, fps: float = AT_FPS) -> Column:
    """Whether a name that entered is expected to be there still."""
    return F.coalesce(exit_times(entered, fps)["left"] > frame, F.lit(False))


def map_text(m: Column, between: str = ",", after: str = "|") -> Column:
    """The entries of a map, in their order, as text."""
    return F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"].cast("string"), F.lit(between), e["value"].cast("string"))), after)


def time_text(ms: Column, zone: str = "UTC", form: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """An instant in milliseconds as a place's date and time."""
    return F.date_format(F.from_utc_timestamp(F.timestamp_millis(ms), zone), form)


def random_int(end: int, start: int = 0, seed: int | None = None) -> Column:
    """A whole number from *start* to *end*, without *end*."""
    return F.floor(F.rand(seed) * (end - start) + start)


def chance(share: float = 0.5, seed: int | None = None) -> Column:
    return F.rand(seed) <= share


def one_or(test: Column, otherwise: int = 0) -> Column:
    """1 where the test holds, else *otherwise*."""
    return F.when(test, 1).otherwise(otherwise)
