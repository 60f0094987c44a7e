"""Weighted letter similarity between names, and labels for its scores.

The distance is the time-warping recurrence over letter costs: every step of the path adds the cost of the
two letters that meet, so repeated letters collapse for nothing.  It is not an edit distance, and it is asymmetric.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# Groups of letters that a reader confuses.  Of several groups that hold a letter, the last counts.
CONFUSED = ("oO0n", "itrn", "il|fL1", "aesog", "ecuw", "oc", "a8B", "sz", "RA", "Yvy", "4dAa", "d9", "7T", "gy", "CG")
NEIGHBOURS = {letter: group for group in CONFUSED for letter in group}

# Labels of a distance by its upper bound.
LABELS = ((0, "PERFECT"), (2, "LIKELY"), (5, "UNLIKELY"), (9, "BAD"), (12, "UNKNOWN"))
#: A border cell of the recurrence costs this a step.
BORDER = 2


@functools.lru_cache(maxsize=65_536)
def letter_cost(a: str, b: str, case_penalty: bool = True) -> int:
    """0 for equal letters, 1 (or 0) for other case, 1 where b is a neighbour of a, else 2."""
    if a == b:
        return 0
    if a.lower() == b.lower():
        return int(case_penalty)
    return 1 if b in NEIGHBOURS.get(a, "") else 2


def warped_distances(test: str, names: list[str], case_penalty: bool = True) -> np.ndarray:
    """The distance of *test* to every name, all names of like length at once, so that none is padded to more than twice its length."""
    lengths = np.fromiter(map(len, names), np.int64, len(names))
    sizes = np.frexp(lengths)[1]
    out = np.empty(len(names), np.int64)
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        out[at] = _warped_alike(test, [names[i] for i in at.tolist()], lengths[at], case_penalty)
    return out


def _warped_alike(test: str, names: list[str], lengths: np.ndarray, case_penalty: bool) -> np.ndarray:
    width = int(lengths.max(initial=0))
    letters, codes = np.unique(np.array(list("".join(n.ljust(width, "\0") for n in names)) or ["\0"]), return_inverse=True)
    codes = codes[: len(names) * width].reshape(len(names), width)
    row = np.broadcast_to(np.arange(width + 1, dtype=np.int64)[:, None] * BORDER, (width + 1, len(names))).copy()
    for x, letter in enumerate(test, 1):
        costs = np.array([letter_cost(letter, b, case_penalty) for b in letters.tolist()], np.int64)[codes.T]
        after = np.empty_like(row)
        after[0] = x * BORDER
        for y in range(1, width + 1):
            after[y] = costs[y - 1] + np.minimum(np.minimum(row[y], row[y - 1]), after[y - 1])
        row = after
    return row[lengths, np.arange(len(names))]


def warped_distance(test: str, match: str, case_penalty: bool = True) -> int:
    """The distance of one pair."""
    row = list(range(0, BORDER * len(match) + 1, BORDER))
    for x, a in enumerate(test, 1):
        left, diagonal, after = x * BORDER, row[0], [x * BORDER]
        for b, up in zip(match, row[1:], strict=True):
            left = letter_cost(a, b, case_penalty) + min(left, diagonal, up)
            after.append(left)
            diagonal = up
        row = after
    return row[-1]


def _codes(names: list[str], letters: dict[str, int]) -> np.ndarray:
    width = max(map(len, names), default=0)
    return np.array([[letters.setdefault(c, len(letters)) for c in n] + [0] * (width - len(n)) for n in names], np.int64).reshape(len(names), width)


def warped_pairs(tests: list[str], matches: list[str], case_penalty: bool = True) -> np.ndarray:
    """The distance of every pair, all pairs at once."""
    letters: dict[str, int] = {}
    a, b = _codes(tests, letters), _codes(matches, letters)
    costs = np.array([[letter_cost(x, y, case_penalty) for y in letters] for x in letters] or [[0]], np.int64)
    size_a, size_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (tests, matches))
    every = np.arange(len(tests))
    row = np.repeat(np.arange(b.shape[1] + 1)[:, None] * BORDER, len(tests), axis=1)
    out = row[size_b, every]
    for x in range(1, a.shape[1] + 1):
        after = np.empty_like(row)
        after[0] = x * BORDER
        for y in range(1, b.shape[1] + 1):
            after[y] = costs[a[:, x - 1], b[:, y - 1]] + np.minimum(np.minimum(row[y], row[y - 1]), after[y - 1])
        row = after
        done = size_a == x
        out[done] = row[size_b[done], every[done]]
    return out


@F.pandas_udf(LongType())
def pair_distance(test: pd.Series, match: pd.Series) -> pd.Series:
    """The distance of each pair; null where either is null."""
    out = pd.Series([None] * len(test), dtype="Int64")
    known = np.flatnonzero((test.notna() & match.notna()).to_numpy())
    # Pairs of like length go together, so that little is computed for padding.
    order = known[np.argsort((test.str.len() + match.str.len()).to_numpy()[known], kind="stable")]
    for at in range(0, len(order), 4096):
        own = order[at : at + 4096]
        out.iloc[own] = warped_pairs(test.iloc[own].tolist(), match.iloc[own].tolist())
    return out


def letter_cost_column(a: Column, b: Column) -> Column:
    """letter_cost in SQL functions."""
    near = F.create_map(*(F.lit(x) for pair in NEIGHBOURS.items() for x in pair))
    return F.when(a == b, 0).when(F.lower(a) == F.lower(b), 1).when(F.contains(F.coalesce(F.try_element_at(near, a), F.lit("")), b), 1).otherwise(2)


def warped_distance_column(test: Column, match: Column) -> Column:
    """The distance in SQL functions alone, slower than pair_distance: a fold over the letters, carrying a row."""
    def letters(s: Column) -> Column:
        return F.filter(F.split(s, ""), lambda c: c != "")

    first = F.transform(F.sequence(F.lit(0), F.length(match)), lambda y: y * BORDER)

    def step(row: Column, at: Column) -> Column:
        a = at["letter"]
        start = F.array((F.get(row, F.lit(0)) + BORDER).cast("int"))
        cells = F.transform(letters(match), lambda b, y: F.struct(letter_cost_column(a, b).alias("cost"), F.least(F.get(row, y), F.get(row, y + 1)).alias("low")))
        return F.aggregate(cells, start, lambda acc, c: F.concat(acc, F.array((c["cost"] + F.least(c["low"], F.element_at(acc, -1))).cast("int"))))

    tests = F.transform(letters(test), lambda c: F.struct(c.alias("letter")))
    return F.element_at(F.aggregate(tests, first.cast("array<int>"), step), -1)


def stepped(value: Column, steps: tuple[tuple[float, str], ...]) -> Column:
    """The name of the first step that is not below the value, else of the last."""
    out = None
    for bound, name in steps:
        out = F.when(value <= bound, name) if out is None else out.when(value <= bound, name)
    return out.otherwise(steps[-1][1])


def match_label(distance: Column) -> Column:
    return F.when(distance.isNotNull(), stepped(distance, LABELS))


def normalised(distance: Column, test: Column, match: Column) -> Column:
    """The distance as a share of the most that names of these lengths can have."""
    return distance / (F.greatest(F.length(test), F.length(match)) * BORDER)


def found_letters_score(test: Column, match: Column) -> Column:
    """The older score: -1 for each letter found, the gap between the places found, 2 for one missing; null if a letter runs out.

    The n-th of a letter's occurrences in *test* is found at its n-th place in *match*.  A gap is measured from the place found before, unless
    that is the first, as in the score that it mirrors.
    """
    own = F.filter(F.split(test, ""), lambda c: c != "")
    other = F.filter(F.split(match, ""), lambda c: c != "")
    places = F.transform(other, lambda c, i: F.struct(c.alias("letter"), i.alias("at")))

    def place(c: Column, i: Column) -> Column:
        mine = F.filter(places, lambda p: p["letter"] == c)
        before = F.size(F.filter(F.slice(own, F.lit(1), i), lambda x: x == c))
        return F.struct((F.size(mine) > 0).alias("there"), F.get(mine, before)["at"].alias("at"))

    at = F.transform(own, place)
    found = F.transform(F.filter(at, lambda x: x["there"]), lambda x: x["at"])
    gaps = F.zip_with(found, F.slice(found, F.lit(2), F.greatest(F.size(found) - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull() & (a > 0), F.abs(a + 1 - b)).otherwise(F.lit(0)))
    score = F.aggregate(gaps, 2 * F.size(F.filter(at, lambda x: ~x["there"])) - F.size(found), lambda s, g: s + g)
    return F.when(~F.exists(found, lambda x: x.isNull()), score)
