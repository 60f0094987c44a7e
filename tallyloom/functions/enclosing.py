"""The colour whose largest redmean distance to a set of colours is least, exactly.

512 times the square of a redmean distance is a whole number, so nothing is rounded.  First, in SQL functions, colours that can never be the farthest go: of those of one red and
green only the least and the largest blue can be, of those of one red and blue only the least and the largest green, as the distance is convex along these lines.
A group is then 131,072 colours at most.  The search holds a small basis of colours: it finds the best centre for the basis, looks
for the colour that is farthest from it, and takes that in, until the farthest is no farther than the basis says.  For a basis, boxes of centres are split in eight as long as a lower bound of the
box is not above the best centre seen.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The largest value of a channel.
TOP = 255


def may_be_farthest(df: DataFrame, keys: list[str]) -> DataFrame:
    """Those of the colours (keys, r, g, b) that can be farthest from any centre, each once."""
    for along in ("b", "g"):
        others = [c for c in "rgb" if c != along]
        ends = df.groupBy(*keys, *others).agg(F.min(along).alias("__low"), F.max(along).alias("__high"))
        df = ends.select(*keys, *others, F.explode(F.array_distinct(F.array("__low", "__high"))).alias(along))
    return df.select(*keys, *"rgb")


def squares(centers: np.ndarray, colors: np.ndarray) -> np.ndarray:
    """512 times the squared redmean distance of each centre to each colour, in whole numbers."""
    red = centers[:, None, 0] + colors[None, :, 0]
    r, g, b = np.moveaxis((centers[:, None] - colors[None]) ** 2, 2, 0)
    return (1024 + red) * r + 2048 * g + (1534 - red) * b


def bound(low: np.ndarray, high: np.ndarray, colors: np.ndarray) -> np.ndarray:
    """What no centre of a box can be below."""
    near = np.maximum(np.maximum(low[:, None] - colors[None], colors[None] - high[:, None]), 0) ** 2
    weights = 1024 + low[:, None, 0] + colors[None, :, 0], 1534 - high[:, None, 0] - colors[None, :, 0]
    return (weights[0] * near[..., 0] + 2048 * near[..., 1] + weights[1] * near[..., 2]).max(axis=1)


def best_center(colors: np.ndarray, top: int = TOP) -> tuple[np.ndarray, int]:
    """(centre, its largest square) of a few colours; of several best centres the one that comes first."""
    size = 1 << int(top).bit_length()
    low, best = np.zeros((1, 3), np.int64), np.iinfo(np.int64).max
    eighths = np.array(np.meshgrid((0, 1), (0, 1), (0, 1), indexing="ij")).reshape(3, 8).T
    while True:
        high = np.minimum(low + size - 1, top)
        least = bound(low, high, colors)
        best = min(best, int(squares((low + high) // 2, colors).max(axis=1).min()))
        low = low[least <= best]
        if size == 1:
            return low[np.lexsort(low.T[::-1])[0]], best
        size //= 2
        low = (low[:, None] + eighths[None] * size).reshape(-1, 3)
        low = low[(low <= top).all(axis=1)]


def enclosing(colors: np.ndarray, top: int = TOP) -> tuple[np.ndarray, int]:
    """(centre, its largest square) of any number of colours."""
    basis, center = colors[:1], (colors.min(axis=0) + colors.max(axis=0)) // 2
    value = -1
    while True:
        far = squares(center[None], colors)[0]
        if far.max() <= value:
            return center, value
        basis = np.concatenate((colors[far.argmax()][None], basis))
        center, value = best_center(basis, top)


def enclosing_colors(df: DataFrame, keys: list[str], p: tuple[str, str, str] = ("r", "g", "b"), top: int = TOP) -> DataFrame:
    """(keys, r, g, b, distance): for each group the colour, channels from 0 to *top*, whose largest redmean distance to the group's colours is least.

    Of several such colours it is the one that comes first.  Each different colour counts once; colours with a null channel count nothing.
    """
    own = df.select(*keys, *(F.col(c).cast("int").alias(n) for c, n in zip(p, "rgb", strict=True))).dropna(subset=list("rgb"))
    kinds = ", ".join(f"{k} {t}" for k, t in own.dtypes[: len(keys)])

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        center, square = enclosing(rows[["r", "g", "b"]].to_numpy(np.int64), top)
        return pd.DataFrame([(*key, *center.tolist(), np.sqrt(square / 512))], columns=[*keys, "r", "g", "b", "distance"])

    return may_be_farthest(own, keys).groupBy(*keys).applyInPandas(run, f"{kinds}, r int, g int, b int, distance double")
