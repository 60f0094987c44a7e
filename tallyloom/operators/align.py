"""Aligning what is seen on screen with what was expected there.

Sequences are short (a screen's slots), runs are many: the set forms join and group by run; the
exact folds are plain functions over one screen, used by the trackers in batch and in streams.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Good visual matches need this many slots that found an entity of their length.
LEAST_VOTES = 2
#: A shift match is good beyond this share.
GOOD_SHARE = 0.7


def offset_votes(predicted: DataFrame, visible: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, offset, votes): for how many visible slots an entity of equal length lies at the offset.

    *predicted*: (keys, pidx, length), *visible*: (keys, vidx, length).  An equi-join on run and length.
    """
    joined = visible.where("length is not null").join(predicted.where("length is not null"), [*keys, "length"])
    return joined.groupBy(*keys, (F.col("pidx") - F.col("vidx")).alias("offset")).agg(F.countDistinct("vidx").alias("votes"))


def best_offsets(votes: DataFrame, keys: list[str]) -> DataFrame:
    """The offset of most votes, the closest to 0 of equals, then the smaller; good from LEAST_VOTES on."""
    w = Window.partitionBy(*keys).orderBy(F.desc("votes"), F.abs("offset"), "offset")
    return votes.withColumn("rank", F.row_number().over(w)).where("rank = 1").select(*keys, "offset", "votes", (F.col("votes") >= LEAST_VOTES).alias("good"))


def visual_offset(predicted: Sequence[int | None], visible: Mapping[int, int | None]) -> tuple[int | None, bool]:
    """(offset, good) by the exact, order-dependent fold.

    Each visible slot whose length some entity has gives the list of its offsets.  If any has several, shorter lists come first and
    longer ones are ordered from 0 outwards.  Folding from the left, the first offset of a list that the
    result so far holds is the new result, and none ends it.
    """
    at: dict[int, list[int]] = {}
    for p, length in enumerate(predicted):
        if length is not None:
            at.setdefault(length, []).append(p)
    lists = [[p - v for p in at[length]] for v, length in visible.items() if length in at]
    if any(len(x) > 1 for x in lists):
        lists = [sorted(x, key=abs) if len(x) > 1 else x for x in sorted(lists, key=len)]
    if not lists:
        return None, False
    held: list[int | None] = list(lists[0])
    for x in lists[1:]:
        held = [next((o for o in x if o in held), None)]
        if held[0] is None:
            break
    return held[0], len(lists) >= LEAST_VOTES and held[0] is not None


def shift_shares(predicted: DataFrame, visible: DataFrame, keys: list[str], tolerance: int = 3) -> DataFrame:
    """(keys, shift, matched, unknown, share): how well the visible slots fit when the first of them is at each entity.

    A slot past the last entity doesn't match; one at an entity of unknown length counts half.  share: matched / (slots - unknown / 2).
    Shifts are the entities of the run, so the rows are slots times entities of one screen.
    """
    first = visible.groupBy(*keys).agg(F.min("vidx").alias("first"), F.count("*").alias("slots"))
    shifts = predicted.select(*keys, F.col("pidx").alias("shift"))
    wanted = shifts.join(visible.select(*keys, "vidx", F.col("length").alias("seen")), keys).join(first, keys).withColumn("pidx", F.col("shift") + F.col("vidx") - F.col("first"))
    own = wanted.join(predicted.select(*keys, "pidx", "length", F.lit(1).alias("there")), [*keys, "pidx"], "left")
    hit = F.col("there").isNotNull() & (F.abs(F.col("length") - F.col("seen")) < tolerance)
    unknown = F.col("there").isNotNull() & F.col("length").isNull()
    counts = own.groupBy(*keys, "shift", "slots", "first").agg(F.count(F.when(hit, 1)).alias("matched"), F.count(F.when(unknown, 1)).alias("unknown"))
    return counts.select(*keys, (F.col("shift") - F.col("first")).alias("offset"), "shift", "matched", "unknown", (F.col("matched") / (F.col("slots") - F.col("unknown") * 0.5)).alias("share"))


def best_shift(shares: DataFrame, keys: list[str]) -> DataFrame:
    """The first shift that is good, else the first of the greatest share; no row where no slot matches."""
    good = F.when(F.col("share") > GOOD_SHARE, 0).otherwise(1)
    w = Window.partitionBy(*keys).orderBy(good, F.when(good == 1, -F.col("share")).otherwise(F.lit(0.0)), "shift")
    return shares.where("share > 0").withColumn("rank", F.row_number().over(w)).where("rank = 1").select(*keys, "offset", "share", (F.col("share") > GOOD_SHARE).alias("good"))


def wildcard_offsets(predicted: DataFrame, visible: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, offset): offsets at which no colour conflicts; a null colour fits every other.

    Candidates put a visible slot on the last coloured entity.  A slot is compared if it lies above the slot that made the candidate
    and, there, on an entity.
    """
    last = predicted.where("color is not null").groupBy(*keys).agg(F.max(F.struct("pidx", "color")).alias("last"))
    made = visible.join(last, keys).where((F.col("color").isNull() | (F.col("color") == F.col("last.color"))) & (F.col("last.pidx") >= F.col("vidx")))
    candidates = made.select(*keys, (F.col("last.pidx") - F.col("vidx")).alias("offset"), F.col("vidx").alias("anchor"))
    seen = candidates.join(visible.where("color is not null").select(*keys, "vidx", F.col("color").alias("seen")), keys).where(F.col("vidx") < F.col("anchor"))
    met = seen.withColumn("pidx", F.col("vidx") + F.col("offset")).join(predicted.where("color is not null").select(*keys, "pidx", "color"), [*keys, "pidx"])
    conflicts = met.where(F.col("seen") != F.col("color")).select(*keys, "offset").distinct()
    return candidates.select(*keys, "offset").distinct().join(conflicts, [*keys, "offset"], "left_anti")


def fits(a: object, b: object) -> bool:
    return a is None or b is None or a == b


def edges_by_index(values: Sequence, same=lambda a, b: a == b) -> list[int] | None:
    """Number of changes up to each place; None for fewer than two values."""
    if len(values) < 2:
        return None
    out = [0]
    for before, now in zip(values, values[1:], strict=False):
        out.append(out[-1] + (not same(before, now)))
    return out


def color_offset(predicted: Sequence[str | None], visible: Mapping[int, str | None]) -> tuple[int | None, bool]:
    """(offset, good) by colours, walking up from the last visible slot.

    Of several offsets that survive the smallest is taken, good if the number of edges differs at the smallest two;
    one or none is good.  Without a coloured entity, or a visible slot, there is none and it isn't good.
    """
    coloured = [p for p, c in enumerate(predicted) if c is not None]
    if not coloured or not visible:
        return None, False
    last, alive = coloured[-1], []
    for v, c in reversed(list(visible.items())):
        if c is not None:
            alive = [o for o in alive if not 0 <= v + o < len(predicted) or fits(predicted[v + o], c)]
        if fits(c, predicted[last]) and last - v >= 0 and last - v not in alive:
            alive.append(last - v)
    alive.sort()
    if len(alive) < 2:
        return (alive[0] if alive else None), True
    edges = edges_by_index(predicted, fits) or []
    at = [edges[o] if o < len(edges) else None for o in alive[:2]]
    return alive[0], at[0] != at[1]


def length_scores(lengths: Sequence[int | None]) -> list[tuple[float, int]]:
    """(score, index) of the lengths that tell most, best first; see windows.neighbour_scores."""
    sharing: dict[int, int] = {}
    for x in lengths:
        if x:
            for k in (x - 1, x):
                sharing[k] = sharing.get(k, 0) + 1
    out = []
    for i, x in enumerate(lengths):
        if x:
            around = [lengths[j] if 0 <= j < len(lengths) and lengths[j] is not None else x for j in (i - 1, i + 1)]
            score = sum(abs(x - y) for y in around) / 2 + 1
            for k in (x - 1, x):
                score /= sharing[k]
            out.append((score, i))
    return sorted(out, key=lambda s: -s[0])
