"""Stateful streams: the tracker of each run, the life cycle of a run, and viewers that are active."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState

from tallyloom.operators import lifecycle
from tallyloom.operators.tracking import LOG, Entity, Run, log_of
from tallyloom.sources import frames

#: A run's numbers and an entity, as they are kept.
RUN = "first int, known boolean, quiet int, last_frame bigint, status string"
ENTITY = "length int, color string, seen boolean, entered bigint, left bigint, name string, processing boolean"

class Tracking(StatefulProcessor):
    """One run: its numbers in one value, each entity under its number.

    A batch reads the entities that may be on screen, and writes those that it changed.
    """

    def __init__(self, quick: bool, idle_ms: int | None) -> None:
        self.quick, self.idle_ms = quick, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", RUN)
        self.entities = handle.getMapState("entities", "idx int", ENTITY)

    def _held(self) -> Run:
        if not self.run.exists():
            return Run()
        first, known, quiet, last_frame, status = self.run.get()
        own, at = [], first
        while self.entities.containsKey((at,)):
            own.append(Entity(*self.entities.getValue((at,))))
            at += 1
        return Run(own, first, first, known, quiet, last_frame, status)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        own = self._held()
        before = [astuple(e) for e in own.entities]
        yield log_of(key[0], own, pd.concat(list(rows)), self.quick)
        if own.status == "COMPLETE":
            self.entities.clear()
        else:
            for i, e in enumerate(own.entities):
                if i >= len(before) or astuple(e) != before[i]:
                    self.entities.updateValue((own.base + i,), astuple(e))
        self.run.update((own.first, own.known, own.quiet, own.last_frame, own.status))
        if self.idle_ms:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.run.clear()
        self.entities.clear()
        yield from ()


def track_stream(observations: DataFrame, quick: bool = False, idle_ms: int | None = None) -> DataFrame:
    """As operators.tracking.track, over a stream; needs the state store that keeps several columns (RocksDB).

    A batch's rows of one run are put together and taken in frame order; a frame at or before the last one taken is late and dropped.
    Entities that have left stay as they were written, so what a batch writes doesn't grow with them.  Of a run that is over only this is remembered, without its entities.  With *idle_ms*, for a query that
    runs on without end, a run without a frame for so many milliseconds is forgotten, and begins anew if it comes back; a query that stops at the end of its input must go without.
    """
    return observations.groupBy("run_id").transformWithStateInPandas(Tracking(quick, idle_ms), LOG, "Append", "ProcessingTime" if idle_ms else "None")


def tracked_entities(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """(run_id, idx, length, color, seen, entered, left, name, processing): what a query of track_stream knew of all entities after its last batch, or another."""
    read = spark.read.format("statestore").option("stateVarName", "entities")
    held = (read if batch is None else read.option("batchId", batch)).load(checkpoint)
    return held.select("key.run_id", "user_map_key.idx", "user_map_value.*")


def follow_stream(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """As operators.lifecycle.follow, over a stream of (run_id, at, event); a batch's events of one run are taken in order of their time."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before = state.get[0] if state.exists else lifecycle.STOPPED
        out = lifecycle.steps(key[0], before, pd.concat(list(batches)))
        if len(out):
            before = out["after"].iloc[-1]
        yield out
        state.update((before,))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)

    return events.groupBy("run_id").applyInPandasWithState(run, lifecycle.STEPS, "state string", "append", frames.timeout(idle_ms))


def quiet_runs(events: DataFrame, keys: list[str], time: str, quiet: str = "5 seconds", late: str = "10 seconds") -> DataFrame:
    """(keys, started, ended, n): stretches of a run that a quiet time ends, once the watermark has passed it."""
    w = F.session_window(F.col(time), quiet)
    return events.withWatermark(time, late).groupBy(*keys, w).agg(F.min(time).alias("started"), F.max(time).alias("ended"), F.count("*").alias("n")).drop("session_window")


def viewers_per_window(pings: DataFrame, viewer: str, time: str, window: str = "1 minute", late: str = "1 minute") -> DataFrame:
    """(since, active): distinct viewers of each window, by an approximate count whose state is bounded."""
    w = F.window(F.col(time), window)
    return pings.withWatermark(time, late).groupBy(w).agg(F.approx_count_distinct(viewer).alias("active")).select(F.col("window.start").alias("since"), "active")
