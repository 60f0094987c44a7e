"""Colour arithmetic on columns of red, green and blue from 0 to 255."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The largest distance of two colours.
FARTHEST = math.sqrt(3 * 255**2)

# Centres and side lengths of the colour boxes of the names on screen.
BOXES = {
    "SUB_BLUE": ((122, 146, 228), (38, 31, 61)),
    "UNSUB_WHITE": ((245, 246, 244), (45, 28, 47)),
    "STREAMER_RED": ((238, 138, 140), (70, 36, 30)),
    "VIP_PINK": ((199, 27, 174), (50, 55, 50)),
    "MOD_GREEN": ((145, 243, 210), (89, 29, 56)),
}


def rotate(matrix: list[list[float]], p: tuple[Column, Column, Column]) -> tuple[Column, ...]:
    """p times the matrix: the j-th number is the sum over i of p[i] matrix[i][j]."""
    return tuple(sum((p[i] * float(matrix[i][j]) for i in range(1, 3)), p[0] * float(matrix[0][j])) for j in range(3))


def offset_from(center: tuple[float, float, float], p: tuple[Column, Column, Column], matrix: list[list[float]] | None = None) -> tuple[Column, ...]:
    own = tuple(F.lit(float(c)) - x.cast("double") for c, x in zip(center, p, strict=True))
    return rotate(matrix, own) if matrix else own


def in_box(center, sides, p: tuple[Column, Column, Column], scale: float = 1.0, matrix: list[list[float]] | None = None) -> Column:
    """Whether a colour is in the (turned) box, borders included, that is *scale* times as large."""
    test = F.lit(True)
    for d, side in zip(offset_from(center, p, matrix), sides, strict=True):
        test = test & (d / scale).between(-side / 2, side / 2)
    return test


def box_name(p: tuple[Column, Column, Column], scale: float = 1.0, boxes: dict = BOXES) -> Column:
    """The first box that holds the colour, null if none does."""
    out = F.lit(None).cast("string")
    for name, (center, sides) in reversed(list(boxes.items())):
        out = F.when(in_box(center, sides, p, scale), name).otherwise(out)
    return out


def norm(d: tuple[Column, ...]) -> Column:
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def redmean(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """Colour distance weighted by the mean red."""
    mean = (a[0] + b[0]) / 2
    r, g, blue = (x - y for x, y in zip(a, b, strict=True))
    return F.sqrt((2 + mean / 256) * r * r + 4 * g * g + (2 + (255 - mean) / 256) * blue * blue)


def round_up_half(x: Column) -> Column:
    """Nearest whole number, halves towards plus infinity."""
    return F.floor(x + 0.5)


def fall_off(distance: Column, matched: Column, scale: float = 1.0) -> Column:
    """The grey of a pixel: black at the centre, lighter with the distance, faster outside the box."""
    share = F.lit(1.0) - distance / FARTHEST / scale
    return round_up_half(F.lit(255.0) * (F.lit(1.0) - F.pow(share, F.when(matched, 2.0).otherwise(2.5))))


def grey(r: Column, g: Column, b: Column) -> Column:
    """Luma, each term rounded."""
    return round_up_half(r * 0.299) + round_up_half(g * 0.587) + round_up_half(b * 0.114)


def pack(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r.cast("int"), 16) + F.shiftleft(g.cast("int"), 8) + b.cast("int")


def unpack(rgb: Column) -> tuple[Column, Column, Column]:
    return F.shiftrightunsigned(rgb, 16).bitwiseAND(255), F.shiftrightunsigned(rgb, 8).bitwiseAND(255), rgb.bitwiseAND(255)


def hex_of(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *(F.lower(F.lpad(F.hex(c.cast("int")), 2, "0")) for c in (r, g, b)))


def add_clamped(a: Column, b: Column) -> Column:
    return F.least(F.lit(255), F.greatest(F.lit(0), a + b))


def channel_mean_difference(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """Mean absolute difference of the channels."""
    return sum((F.abs(x - y) for x, y in zip(a[1:], b[1:], strict=True)), F.abs(a[0] - b[0])) / 3


def channel_spread(p: tuple[Column, Column, Column]) -> Column:
    """Sum of the differences between each two channels; 0 for greys."""
    return F.abs(p[0] - p[1]) + F.abs(p[1] - p[2]) + F.abs(p[0] - p[2])


# What a slot's letter means to a viewer; any other is unknown.
LEGEND = {"S": "seen", "L": "seen", "O": "processing", "N": "named"}


def legend(letter: Column) -> Column:
    out = F.lit("unknown")
    for k, v in LEGEND.items():
        out = F.when(letter == k, v).otherwise(out)
    return out


def width_percent(length: Column) -> Column:
    """A (negative) length as a share of the longest box, in percent."""
    return length * 100.0 / -294


def overlay_ratio(df: DataFrame, below: tuple[str, str, str], above: tuple[str, str, str]) -> DataFrame:
    """(r, g, b, all): mean of what is above over what is below, by channel and over all; channels of 0 below count nothing."""
    ratios = [F.try_divide(F.col(a), F.col(b)) for a, b in zip(above, below, strict=True)]
    return df.agg(*(F.avg(x).alias(n) for x, n in zip(ratios, "rgb", strict=True)), (sum((F.sum(x) for x in ratios[1:]), F.sum(ratios[0])) / sum((F.count(x) for x in ratios[1:]), F.count(ratios[0]))).alias("all"))
