"""The box of least volume that has a side flush with a face of the points' convex hull.

Hulls merge: a hull of hulls is the hull of all.  Every task makes the hulls of its own points, these meet in a few parts of a group, and only the parts' hulls meet as a group.  Then, for each
direction of a face, the points' shadow along it gets the least rectangle that has a side along an edge of the shadow's own hull.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Of the points' extent, what counts as no distance.
FLAT = 1e-9
#: Parts of a group whose hulls are made before they meet, and groups that a task holds at once.
PARTS, GROUPS = 32, 4096


def _simplex(points: np.ndarray, flat: float) -> list[int]:
    """Up to four points that span what all span, each as far as can be from those before."""
    own = [int(np.lexsort(points.T[::-1])[0])]
    basis = np.zeros((0, 3))
    for _ in range(3):
        rest = points - points[own[0]]
        rest = rest - rest @ basis.T @ basis
        far = np.linalg.norm(rest, axis=1)
        k = int(far.argmax())
        if far[k] <= flat:
            break
        own.append(k)
        basis = np.vstack((basis, rest[k] / far[k]))
    return own


class Hull:
    """The convex hull of points that span the space: faces (three points, outward normal, offset), grown by the point farthest outside."""

    def __init__(self, points: np.ndarray, first: list[int], flat: float) -> None:
        self.points, self.flat = points, flat
        self.inner = points[first].mean(axis=0)
        self.faces: list[tuple[int, int, int]] = []
        self.planes = np.zeros((0, 4))
        self.outside: list[np.ndarray] = []
        self._add(list(combinations(first, 3)), np.arange(len(points)))
        while (place := next((i for i, x in enumerate(self.outside) if len(x)), None)) is not None:
            far = self.above(self.planes[place][None], self.outside[place])[0]
            self._grow(int(self.outside[place][far.argmax()]))

    def above(self, planes: np.ndarray, which: np.ndarray) -> np.ndarray:
        return planes[:, :3] @ self.points[which].T - planes[:, 3:]

    def _add(self, faces: list[tuple[int, int, int]], loose: np.ndarray) -> None:
        """Further faces, and the loose points each to the first of them that it is outside of."""
        for a, b, c in faces:
            normal = np.cross(self.points[b] - self.points[a], self.points[c] - self.points[a])
            size = np.linalg.norm(normal)
            normal = normal / size if size > 0 else normal
            if normal @ (self.inner - self.points[a]) > 0:
                b, c, normal = c, b, -normal
            plane = np.append(normal, normal @ self.points[a])
            out = self.above(plane[None], loose)[0] > self.flat if len(loose) else np.zeros(0, bool)
            self.faces.append((a, b, c))
            self.planes = np.vstack((self.planes, plane))
            self.outside.append(loose[out])
            loose = loose[~out]

    def _grow(self, p: int) -> None:
        seen = self.above(self.planes, np.array([p]))[:, 0] > self.flat
        gone = [self.faces[i] for i in np.flatnonzero(seen)]
        edges = {e for a, b, c in gone for e in ((a, b), (b, c), (c, a))}
        loose = np.concatenate([self.outside[i] for i in np.flatnonzero(seen)])
        kept = np.flatnonzero(~seen)
        self.faces, self.planes, self.outside = [self.faces[i] for i in kept], self.planes[kept], [self.outside[i] for i in kept]
        self._add([(a, b, p) for a, b in sorted(edges) if (b, a) not in edges], loose[loose != p])


def flat_of(points: np.ndarray) -> float:
    return FLAT * max(1e-300, float(np.abs(points - points.mean(axis=0)).max(initial=0)))


def hull_points(points: np.ndarray) -> np.ndarray:
    """Those of the points that their hull has as corners, or few more; flat or straight ones stay as they are but for repeats, and the ends of a line."""
    points = np.unique(points, axis=0)
    flat = flat_of(points)
    first = _simplex(points, flat)
    if len(first) == 4:
        return points[sorted({i for f in Hull(points, first, flat).faces for i in f})]
    if len(first) == 2:
        return points[first]
    if len(first) == 3:
        _, _, axes = np.linalg.svd(points - points.mean(axis=0), full_matrices=False)
        return points[_around(points @ axes[:2].T)]
    return points[:1]


def _around(flat: np.ndarray) -> np.ndarray:
    """The corners of the hull of points of a plane, in order."""
    order = np.lexsort((flat[:, 1], flat[:, 0]))

    def half(turn: np.ndarray) -> list[int]:
        out: list[int] = []
        for i in turn.tolist():
            while len(out) > 1:
                a, b = flat[out[-1]] - flat[out[-2]], flat[i] - flat[out[-1]]
                if a[0] * b[1] - a[1] * b[0] > 0:
                    break
                out.pop()
            out.append(i)
        return out

    return np.array(list(dict.fromkeys(half(order)[:-1] + half(order[::-1])[:-1])) or [0])


def _axes_along(normal: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Three axes, the normal first, whose rectangle about the points' shadow is least."""
    side = np.cross(normal, np.eye(3)[np.abs(normal).argmin()])
    u = side / np.linalg.norm(side)
    v = np.cross(normal, u)
    shadow = points @ np.array([u, v]).T
    corner = shadow[_around(shadow)]
    edges = np.roll(corner, -1, axis=0) - corner if len(corner) > 1 else np.array([[1.0, 0.0]])
    length = np.linalg.norm(edges, axis=1)
    turn = edges[length > 0] / length[length > 0][:, None] if (length > 0).any() else np.array([[1.0, 0.0]])
    along, across = corner @ turn.T, corner @ np.stack((-turn[:, 1], turn[:, 0]), axis=1).T
    best = turn[(np.ptp(along, axis=0) * np.ptp(across, axis=0)).argmin()]
    return np.array([normal, best[0] * u + best[1] * v, -best[1] * u + best[0] * v])


def least_box(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(axes as rows, least, most along each) of the box of least volume among those with a side along a face."""
    flat = flat_of(points)
    first = _simplex(points, flat)
    if len(first) == 4:
        normals = np.unique(np.round(Hull(points, first, flat).planes[:, :3], 12), axis=0)
        normals = normals[np.linalg.norm(normals, axis=1) > 0.5]
    elif len(first) == 3:
        cross = np.cross(points[first[1]] - points[first[0]], points[first[2]] - points[first[0]])
        normals = (cross / np.linalg.norm(cross))[None]
    else:
        line = points[first[1]] - points[first[0]] if len(first) == 2 else np.array([1.0, 0.0, 0.0])
        side = np.cross(line, np.eye(3)[np.abs(line).argmin()])
        normals = (side / np.linalg.norm(side))[None]
    best, found = np.inf, None
    for normal in normals:
        axes = _axes_along(normal, points)
        at = points @ axes.T
        volume = float(np.prod(np.ptp(at, axis=0)))
        if found is None or volume < best:
            best, found = volume, (axes, at.min(axis=0), at.max(axis=0))
    return found


def hull_boxes(points: DataFrame, keys: list[str], p: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """(keys, axes, least, most, volume): for each group the least box along a face of its hull; *axes* are three unit vectors, and least and most the extent along each.

    Flat groups have a volume of 0 and the least rectangle of their plane.  Points with a null or non-finite coordinate count nothing.
    """
    given, keys = keys, [f"k{i}" for i in range(len(keys))]
    names = [*keys, *"xyz"]
    own = points.select(*(F.col(g).alias(k) for g, k in zip(given, keys, strict=True)), *(F.col(c).cast("double").alias(n) for c, n in zip(p, "xyz", strict=True)))
    own = own.where(~(F.isnan("x") | F.isnan("y") | F.isnan("z")) & (F.abs("x") + F.abs("y") + F.abs("z") < float("inf")))
    kinds = ", ".join(f"{k} {t}" for k, t in own.dtypes)

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def told() -> pd.DataFrame:
            rows = [(*key, *row) for key, own in held.items() for row in own.tolist()]
            return pd.DataFrame(rows, columns=names)

        for batch in batches:
            groups = batch.groupby(keys, dropna=False, sort=False) if keys else [((), batch)]
            for key, rows in groups:
                key = key if isinstance(key, tuple) else (key,)
                key = tuple(None if pd.isna(k) else k for k in key)
                new = rows[list("xyz")].to_numpy(np.float64)
                held[key] = hull_points(np.concatenate((held[key], new)) if key in held else new)
            if len(held) > GROUPS:
                yield told()
                held.clear()
        if held:
            yield told()

    def boxed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        axes, least, most = least_box(hull_points(rows[list("xyz")].to_numpy(np.float64)))
        return pd.DataFrame([(*key, axes.tolist(), least.tolist(), most.tolist(), float(np.prod(most - least)))], columns=[*keys, "axes", "least", "most", "volume"])

    parts = own.mapInPandas(merged, kinds).withColumn("part", F.pmod(F.xxhash64("x", "y", "z"), F.lit(PARTS)))
    parts = parts.groupBy(*keys, "part").applyInPandas(lambda key, rows: pd.DataFrame([(*key[:-1], *r) for r in hull_points(rows[list("xyz")].to_numpy(np.float64)).tolist()], columns=names), kinds)
    told = ", ".join([*(f"{k} {t}" for k, t in own.dtypes[: len(keys)]), "axes array<array<double>>", "least array<double>", "most array<double>", "volume double"])
    return parts.groupBy(*keys).applyInPandas(boxed, told).toDF(*given, "axes", "least", "most", "volume")
