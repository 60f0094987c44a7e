"""The life of a run: stopped, waiting for its screen, reading, complete; what moves it on, and when it did.

A state depends on all events before it.  A stream folds them in order; a batch composes what they do, so that no task has to hold a run.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.operators.ranges import borders, doubled, range_of

STOPPED, WAITING, READING, COMPLETE = "STOPPED", "WAITING", "READING", "COMPLETE"

#: (event, state before): state after; all others stay as they are.
MOVES = {
    ("start", STOPPED): WAITING,
    ("start", COMPLETE): WAITING,
    ("screen", WAITING): READING,  # the screen before a race is in sight
    ("quiet", READING): COMPLETE,  # no name for long enough
    **{("force", s): READING for s in (STOPPED, WAITING, COMPLETE)},
    **{(e, s): STOPPED for e in ("stop", "clear") for s in (WAITING, READING, COMPLETE)},
}

#: States by their number.
STATES = (STOPPED, WAITING, READING, COMPLETE)
STEPS = "run_id string, at timestamp, event string, before string, after string"


def steps(run_id: str, state: str, events: pd.DataFrame) -> pd.DataFrame:
    """The states before and after each event of a run; *events*: (at, event)."""
    own = events.sort_values(["at", "event"], kind="stable")
    states = [state]
    for event in own["event"]:
        states.append(MOVES.get((event, states[-1]), states[-1]))
    return pd.DataFrame({"run_id": run_id, "at": own["at"].to_numpy(), "event": own["event"].to_numpy(), "before": states[:-1], "after": states[1:]})


def _map_of(event: Column) -> Column:
    """What an event does to each state, packed: two bits a state, in the order of STATES."""

    def packed(name: str | None) -> int:
        return sum(STATES.index(MOVES.get((name, s), s)) << 2 * i for i, s in enumerate(STATES))

    out = F.lit(packed(None))
    for name in sorted({e for e, _ in MOVES}):
        out = F.when(event == name, packed(name)).otherwise(out)
    return out


def _applied(moves: Column, state: Column) -> Column:
    return F.call_function("shiftright", moves, state * 2).bitwiseAND(3)


def _composed(later: Column, earlier: Column) -> Column:
    """The map that does *earlier*, then *later*."""
    each = [F.shiftleft(_applied(later, _applied(earlier, F.lit(i))), 2 * i) for i in range(len(STATES))]
    return sum(each[1:], each[0])


def follow(events: DataFrame, ranges: int | None = None) -> DataFrame:
    """(run_id, at, event, before, after) for each of (run_id, at, event), every run being stopped at first.

    Events of one time go by name.  Null and unknown events move nothing.  An event is a map of four states to four, and such maps compose associatively: those of a stretch of time of a run are
    composed up to each event, the stretches' maps over a run's stretches, and the run's first state goes through both.  So a run of all events is many tasks.
    """
    own = events.select("run_id", F.col("at").cast("timestamp").alias("at"), F.col("event").cast("string").alias("event"), _map_of(F.col("event")).alias("moves"))
    when = F.unix_micros("at")
    own = own.withColumn("part", range_of(when, borders(own, when, ranges)))
    order = [F.col("at").asc_nulls_first(), F.col("event").asc_nulls_last()]
    sizes = own.groupBy("run_id", "part").agg(F.count("*").alias("n"))
    most = sizes.groupBy("run_id").agg(F.max("n").alias("n"), F.count("*").alias("parts")).agg(F.max("n").alias("n"), F.max("parts").alias("parts")).first()
    upto = doubled(own, "moves", ["run_id", "part"], order, most.n or 1, _composed)
    w = Window.partitionBy("run_id", "part").orderBy(*order)
    last = upto.withColumn("next", F.lead(F.lit(1)).over(w)).where(F.col("next").isNull()).select("run_id", "part", "moves")
    whole = doubled(last, "moves", ["run_id"], ["part"], most.parts or 1, _composed)
    first = F.lit(STATES.index(STOPPED))
    begun = F.coalesce(_applied(F.lag("moves").over(Window.partitionBy("run_id").orderBy("part")), first), first)
    begins = whole.select(F.col("run_id").alias("own"), F.col("part").alias("stretch"), begun.alias("begun"))
    met = upto.join(begins, F.col("run_id").eqNullSafe(F.col("own")) & (F.col("part") == F.col("stretch")))
    after = _applied(F.col("moves"), F.col("begun"))
    name = F.array(*(F.lit(s) for s in STATES))
    told = met.withColumn("after", after).withColumn("before", F.coalesce(F.lag("after").over(w), F.col("begun")))
    return told.select(F.col("run_id").cast("string").alias("run_id"), "at", "event", F.get(name, F.col("before")).alias("before"), F.get(name, F.col("after")).alias("after"))


def entered(followed: DataFrame) -> DataFrame:
    """(run_id, state, waiting, reading, complete): the last state of a run, and when it last entered each since it was last cleared."""
    cleared = F.max(F.when(F.col("event") == "clear", F.col("at")))
    last = followed.groupBy("run_id").agg(F.max_by("after", F.struct("at", "event")).alias("state"), cleared.alias("__cleared"))
    moved = followed.where(F.col("before") != F.col("after")).join(last, "run_id").where(F.col("__cleared").isNull() | (F.col("at") > F.col("__cleared")))
    times = moved.groupBy("run_id").agg(*(F.max(F.when(F.col("after") == s, F.col("at"))).alias(s.lower()) for s in (WAITING, READING, COMPLETE)))
    return last.drop("__cleared").join(times, "run_id", "left")


def while_in(rows: DataFrame, followed: DataFrame, states: tuple[str, ...] = (WAITING, READING)) -> DataFrame:
    """Those of *rows* (run_id, at and others) at whose time their run is in one of *states*; an event at that very time has happened.

    Rows and events of a run are put in one order and each row takes the last state before it, so the two are never joined pair by pair.
    """
    own = rows.select("run_id", "at", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("event"), F.lit(None).cast("string").alias("after"), F.struct("*").alias("row"))
    marks = followed.select("run_id", "at", F.lit(0).alias("kind"), "event", "after", F.lit(None).cast(own.schema["row"].dataType).alias("row"))
    upto = Window.partitionBy("run_id").orderBy("at", "kind", "event").rowsBetween(Window.unboundedPreceding, 0)
    state = F.coalesce(F.last("after", ignorenulls=True).over(upto), F.lit(STOPPED))
    return own.union(marks).withColumn("state", state).where(F.col("row").isNotNull() & F.col("state").isin(*states)).select("row.*")
