"""Viewers that are active while a stream runs, exactly: the changes and counts that operators.windows.active_changes gives of the whole.

Two stages with state.  The first is by viewer: its stays that may still grow.  A ping is taken in any order; what the watermark has passed can't change any more, as
later pings are dropped.  So a stay's begin is told when the watermark reaches it, long before it ends, and its end when the watermark reaches that without a ping that carries
it on.  One timer a viewer stands at the next of these times, and a viewer whose last stay is told keeps nothing.  The second adds up all viewers' changes
of one time, and carries the count over the times.  It has a row for each time that changes something, not for each viewer.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: A stay in microseconds, and whether its begin is told.
STAYS = "since array<bigint>, until array<bigint>, told array<boolean>"
CHANGES = "at timestamp, change long"
COUNTS = "at timestamp, change long, active long"

Stay = tuple[int, int, bool]


def merged(stays: list[Stay], times: list[int], interval: int) -> list[Stay]:
    """Stays with further pings: those that touch are one.  What is told of a stay stays told."""
    out: list[Stay] = []
    for since, until, told in sorted([*stays, *((t, t + interval, False) for t in times)]):
        if out and since <= out[-1][1]:
            first, last, was = out[-1]
            out[-1] = (first, max(last, until), was or told)
        else:
            out.append((since, until, told))
    return out


def passed(stays: list[Stay], upto: int) -> tuple[list[tuple[int, int]], list[Stay]]:
    """(changes, stays that go on) once no ping can come at or before *upto*."""
    changes, out = [], []
    for since, until, told in stays:
        if since <= upto and not told:
            changes.append((since, 1))
            told = True
        if until <= upto:
            changes.append((until, -1))
        else:
            out.append((since, until, told))
    return changes, out


def _millis(micros: int) -> int:
    """The first whole millisecond that is not before a time."""
    return -(-micros // 1000)


class ViewerStays(StatefulProcessor):
    """The stays of one viewer."""

    def __init__(self, interval_ms: int) -> None:
        self.interval = interval_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("stays", STAYS)

    def _held(self) -> list[Stay]:
        return list(zip(*self.state.get(), strict=True)) if self.state.exists() else []

    def _keep(self, stays: list[Stay]) -> None:
        """Keep what may still grow, with a timer at the next time to tell; the timers before have nothing to say any more."""
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if stays:
            self.state.update(tuple(list(x) for x in zip(*stays, strict=True)))
            self.handle.registerTimer(min(_millis(until if told else since) for since, until, told in stays))
        elif self.state.exists():
            self.state.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        times = [int(t) for part in rows for t in part["us"]]
        self._keep(merged(self._held(), times, self.interval))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        changes, left = passed(self._held(), timerValues.getCurrentWatermarkInMs() * 1000)
        self._keep(left)
        if changes:
            yield pd.DataFrame({"at": pd.to_datetime([c[0] for c in changes], unit="us"), "change": [c[1] for c in changes]})


class Counter(StatefulProcessor):
    """The count over all viewers, from one time to the next.

    A watermark of the first stage reaches this one in the batch after, so the changes of a time are complete once the watermark has passed it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.active = handle.getValueState("active", "n bigint")
        self.waiting = handle.getMapState("waiting", "us bigint", "change bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for part in rows:
            for us, change in part.groupby("us")["change"].sum().items():
                at = (int(us),)
                before = self.waiting.getValue(at)[0] if self.waiting.containsKey(at) else 0
                self.waiting.updateValue(at, (before + int(change),))
                self.handle.registerTimer(_millis(at[0]))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        ready = sorted((k[0], v[0]) for k, v in self.waiting.iterator() if k[0] <= upto)
        if not ready:
            return
        active = self.active.get()[0] if self.active.exists() else 0
        told = []
        for us, change in ready:
            active += change
            told.append((us, change, active))
            self.waiting.removeKey((us,))
        if active:
            self.active.update((active,))
        elif self.active.exists():
            self.active.clear()
        yield pd.DataFrame({"at": pd.to_datetime([t[0] for t in told], unit="us"), "change": [t[1] for t in told], "active": [t[2] for t in told]})


def viewer_changes(pings: DataFrame, viewer: str, time: str, interval_ms: int, late: str = "1 minute") -> DataFrame:
    """(at, change): +1 where a stay begins and -1 where it ends, once that is certain.  Pings may be *late* and in any order."""
    own = pings.where(F.col(viewer).isNotNull() & F.col(time).isNotNull()).withWatermark(time, late)
    rows = own.select(F.col(viewer).alias("viewer"), F.col(time).alias("at"), F.unix_micros(time).alias("us"))
    return rows.groupBy("viewer").transformWithStateInPandas(ViewerStays(interval_ms), CHANGES, "Append", "EventTime", eventTimeColumnName="at")


def active_viewers(pings: DataFrame, viewer: str, time: str, interval_ms: int, late: str = "1 minute") -> DataFrame:
    """(at, change, active): as operators.windows.active_changes, over a stream; needs the state store that keeps several columns (RocksDB).

    The sum over all viewers of one time is made before the one count, so that gets a row for each time.
    """
    changes = viewer_changes(pings, viewer, time, interval_ms, late)
    rows = changes.select(F.lit(0).alias("all"), "at", F.unix_micros("at").alias("us"), "change")
    return rows.groupBy("all").transformWithStateInPandas(Counter(), COUNTS, "Append", "EventTime")
