"""Points in intervals, as equi-joins: who was on screen in which frame.

An interval goes to the level whose stretches are at least as long as it is, so it touches two of them at most; a point goes to its stretch of
every level that has intervals.  Stretches with many points are split: their points are dealt out, and their intervals go to every part.

Without keys nothing is joined: points and intervals go once to the ranges of time that they are in or touch, and there an interval's points are a slice of the points in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from tallyloom.operators.ranges import MOST_RANGES, borders, range_of

#: Points of a stretch that are joined together.
MOST_POINTS = 50_000
#: Points of a range that are worth a task.
LEAST_POINTS = 1000
#: Rows that are given at once.
TOLD = 1 << 16


def _free(columns: list[str], *names: str) -> list[str]:
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def points_in(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, since: str, until: str, most: int = MOST_POINTS) -> DataFrame:
    """Every row of *points* with every row of *intervals* of the same *keys* for which since <= at < until; whole numbers.

    An interval without an end goes on for ever; one without a begin, or that ends before it begins, holds nothing, and so do null keys.  Columns are the
    points' and then the intervals' without the keys; apart from the keys no name may be in both.
    """
    if not keys:
        return points_in_any(points, intervals, at, since, until, most=most)
    both = [*points.columns, *intervals.columns]
    level, stretch, part, parts = _free(both, "level", "stretch", "part", "parts")
    known = points.where(F.col(at).isNotNull()).dropna(subset=keys)
    last = known.agg(F.max(at)).first()[0]
    end = F.least(F.coalesce(F.col(until), F.lit(last) + 1), F.lit(last) + 1)
    held = intervals.where(F.col(since) < end)
    # The least level whose stretches are as long as the interval: its length written in bits.
    deep = F.length(F.bin(end - F.col(since))).cast("int")
    first, final = (F.call_function("shiftright", x, deep) for x in (F.col(since).cast("long"), (end - 1).cast("long")))
    held = held.withColumns({level: deep, stretch: F.explode(F.array_distinct(F.array(first, final)))})
    levels = [r[0] for r in held.select(level).distinct().collect()]
    spread = known.withColumn(level, F.explode(F.array(*(F.lit(x) for x in levels)) if levels else F.array().cast("array<int>")))
    spread = spread.withColumn(stretch, F.call_function("shiftright", F.col(at).cast("long"), F.col(level)))
    place = [*keys, level, stretch]
    hot = spread.groupBy(*place).agg(F.ceil(F.count("*") / most).cast("int").alias(parts)).where(F.col(parts) > 1)
    n = F.coalesce(F.col(parts), F.lit(1))
    spread = spread.join(hot, place, "left").withColumn(part, F.pmod(F.xxhash64(*points.columns), n).cast("int")).drop(parts)
    held = held.join(hot, place, "left").withColumn(part, F.explode(F.sequence(F.lit(0), n - 1))).drop(parts)
    met = spread.join(held, [*place, part]).where((F.col(since) <= F.col(at)) & F.coalesce(F.col(at) < F.col(until), F.lit(True)))
    return met.select(*points.columns, *(c for c in intervals.columns if c not in keys))


def _slices(place: str, interval: str, begin: str, end: str, points: list[str], held: list[str], names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """An iterator function for mapInArrow over rows by place, in each its points in order and then its intervals: for each interval the *held* columns and a list of its points.

    A list has values where *points* is one column, else structs of them.  One of many points goes on in the next batch.
    """

    def lists(there: pa.Array, times: np.ndarray, own: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ends = own.column(end)
        open_ = ends.is_null().to_numpy(zero_copy_only=False)
        first = np.searchsorted(times, own.column(begin).to_numpy(), "left")
        stop = np.where(open_, len(times), np.searchsorted(times, ends.fill_null(0).to_numpy(), "left"))
        upto = np.cumsum(np.maximum(0, stop - first))
        begins = first - np.concatenate(([0], upto[:-1]))
        # The result's rows are numbered over all intervals of the batch, and some numbers at a time are made.
        for low in range(0, int(upto[-1]), TOLD):
            high = min(low + TOLD, int(upto[-1]))
            a, b = np.searchsorted(upto, (low, high - 1), "right")
            edges = np.concatenate(([low], np.minimum(upto[a : b + 1], high)))
            at = np.arange(low, high) + np.repeat(begins[a : b + 1], np.diff(edges))
            found = pa.ListArray.from_arrays(pa.array((edges - low).astype(np.int32)), there.take(pa.array(at)))
            yield pa.RecordBatch.from_arrays([found, *(own.column(c).slice(a, b + 1 - a) for c in held)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, own, there, times = None, [], None, None
        for batch in batches:
            where = batch.column(place).to_numpy()
            code = where * 2 + batch.column(interval).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), len(code)] if len(code) else []
            for a, b in zip(edges, edges[1:], strict=False):
                if where[a] != here:
                    here, own, there = where[a], [], None
                if not code[a] % 2:
                    own.append(batch.slice(a, b - a))
                elif own:
                    if there is None:
                        all_ = pa.Table.from_batches(own).combine_chunks()
                        times = all_[begin].to_numpy()
                        columns = [all_[c].combine_chunks() for c in points]
                        there = columns[0] if len(points) == 1 else pa.StructArray.from_arrays(columns, points)
                    yield from lists(there, times, batch.slice(a, b - a))

    return run


def points_in_any(points: DataFrame, intervals: DataFrame, at: str, since: str, until: str, columns: list[str] | None = None, most: int = MOST_POINTS) -> DataFrame:
    """As points_in without keys; *columns*: those of the result, all of both tables by default, and the others go nowhere.

    Ranges of time have like numbers of points, so each range within an interval gives it rows: what is sent is no more than an interval's two ends and the rows of the result.  Of a range with many
    points, as of one time, the points are dealt to parts, and its intervals go to every part.  A task holds the points of a part.
    """
    left, right = ([c for c in x.columns if columns is None or c in columns] for x in (points, intervals))
    # A list of points needs a column.
    shown = left or [at]
    place, interval, begin, end, found = _free([*points.columns, *intervals.columns], "place", "interval", "begin", "end", "found")
    known, time = points.where(F.col(at).isNotNull()), F.col(at).cast("long")
    total, low, high = known.agg(F.count("*"), F.min(time), F.max(time)).first()
    wanted = max(-(-2 * total // most), min(2 * int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // LEAST_POINTS), 1)
    cuts = borders(known, time, min(wanted, MOST_RANGES))
    number = range_of(time, cuts)
    split = {r.place: -(-r.n // most) for r in known.groupBy(number.alias("place")).agg(F.count("*").alias("n")).where(F.col("n") > most).collect()}
    parts = F.create_map(*(F.lit(x) for pair in split.items() for x in pair)) if split else None

    def parts_of(number: Column) -> Column:
        return F.lit(1) if parts is None else F.coalesce(F.try_element_at(parts, number), F.lit(1))

    # A place is a range and a part of it.
    each = F.lit(max(split.values(), default=1)).cast("long")
    own = known.select(
        (number * each + F.pmod(F.xxhash64(*points.columns), parts_of(number))).alias(place), F.lit(False).alias(interval), time.alias(begin), F.lit(None).cast("long").alias(end),
        *shown, *(F.lit(None).cast(intervals.schema[c].dataType).alias(c) for c in right),
    )
    begins, ends = F.col(since).cast("long"), F.col(until).cast("long")
    held = intervals.where((begins < F.coalesce(ends, begins + 1)) & (begins <= F.lit(high)) & (F.coalesce(ends, F.lit(high) + 1) > F.lit(low)))
    last = F.when(ends.isNull(), len(cuts)).otherwise(range_of(ends - 1, cuts))
    held = held.withColumn(place, F.explode(F.sequence(range_of(begins, cuts), last)))
    held = held.withColumn(place, F.col(place) * each) if parts is None else held.withColumn(place, F.explode(F.sequence(F.col(place) * each, F.col(place) * each + parts_of(F.col(place)) - 1)))
    held = held.select(place, F.lit(True), begins, ends, *(F.lit(None).cast(points.schema[c].dataType) for c in shown), *right)
    places = min(len(cuts) + 1 + sum(split.values()), 4 * MOST_RANGES)
    rows = own.union(held).repartition(places, place).sortWithinPartitions(place, interval, begin)
    value = StructType([StructField(c, points.schema[c].dataType) for c in shown])
    schema = StructType([StructField(found, ArrayType(value[0].dataType if len(shown) == 1 else value)), *(StructField(c, intervals.schema[c].dataType) for c in right)])
    listed = rows.mapInArrow(_slices(place, interval, begin, end, shown, right, schema.names), schema)
    told = listed.select(F.explode(found).alias(found), *right)
    return told.select(*(F.col(found).alias(c) if len(shown) == 1 else F.col(found)[c].alias(c) for c in left), *right).select(*(columns or [*left, *right]))


def on_screen(frames: DataFrame, entities: DataFrame) -> DataFrame:
    """(run_id, frame, entity) for each frame (run_id, frame) and each entity (run_id, entity, entered, left) that is on screen in it."""
    return points_in(frames.select("run_id", "frame"), entities.select("run_id", "entity", "entered", "left"), ["run_id"], "frame", "entered", "left").select("run_id", "frame", "entity")
