"""Window shapes over ordered observations.  Each takes the partition keys; without them all rows would meet in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tallyloom.operators.ranges import running_sum


def by(keys: list[str], *order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def neighbour_scores(df: DataFrame, keys: list[str], index: str, length: str) -> DataFrame:
    """score: half the differences to both neighbours, plus one, less for lengths that others share.

    A missing neighbour, or one without a length, adds nothing.  A length of n counts under n - 1 and n, and a score
    is divided by the number of entities under each of its two keys.  Rows without a length have no score.
    """
    w, x = by(keys, index), F.col(length)
    own = df.withColumn("score", (F.abs(x - F.coalesce(F.lag(x).over(w), x)) + F.abs(x - F.coalesce(F.lead(x).over(w), x))) / 2 + 1).where(x.isNotNull() & (x != 0))
    # The key n - 1 is that of lengths n - 1 and n, the key n that of n and n + 1; all windows share one partitioning.
    alike = Window.partitionBy(*keys).orderBy(length)
    counts = [F.count("*").over(alike.rangeBetween(*around)) for around in ((-1, 0), (0, 1))]
    return own.withColumn("score", F.col("score") / counts[0] / counts[1])


def running_edges(value: Column, w: WindowSpec) -> Column:
    """How often the value has changed so far, from 0."""
    changed = (~value.eqNullSafe(F.lag(value).over(w))) & (F.row_number().over(w) > 1)
    return changed.cast("long")


def edge_counts(df: DataFrame, keys: list[str], index: str, value: str) -> DataFrame:
    """edges: cumulative number of changes; null for a sequence of one."""
    w = by(keys, index)
    own = df.withColumn("__changed", running_edges(F.col(value), w))
    n = F.count("*").over(Window.partitionBy(*keys))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return own.withColumn("edges", F.when(n > 1, F.sum("__changed").over(upto))).drop("__changed")


def change_scores(df: DataFrame, keys: list[str], index: str, value: str) -> DataFrame:
    """Of rows with a value: how many of their two neighbours differ, an absent one included."""
    w, v = by(keys, index), F.col(value)
    differs = [(~v.eqNullSafe(x.over(w))).cast("long") for x in (F.lag(v), F.lead(v))]
    return df.withColumn("score", differs[0] + differs[1]).where(v.isNotNull())


def rolling(df: DataFrame, keys: list[str], order: list[str], value: str, rows: int) -> DataFrame:
    """Mean and sample deviation of the last *rows* rows."""
    w = by(keys, *order).rowsBetween(1 - rows, 0)
    return df.withColumn("mean", F.avg(value).over(w)).withColumn("sd", F.stddev_samp(value).over(w))


def rate_per_second(df: DataFrame, keys: list[str], order: list[str], millis: str, rows: int = 20) -> DataFrame:
    """rate: 1000 over the mean gap of the last *rows* times."""
    w = by(keys, *order)
    gap = df.withColumn("__gap", F.col(millis) - F.lag(millis).over(w))
    return gap.withColumn("rate", 1000 / F.avg("__gap").over(w.rowsBetween(2 - rows, 0))).drop("__gap")


def lag_to_expected(df: DataFrame, keys: list[str], millis: str, per_second: float) -> DataFrame:
    """Time from the first to the last row beyond what their number should take."""
    return df.groupBy(*keys).agg((F.max(millis) - F.min(millis) - F.count("*") * 1000 / per_second).alias("lag"))


def average_rate(df: DataFrame, keys: list[str], millis: str) -> DataFrame:
    """Rows a second after the first; null for one row."""
    span = F.max(millis) - F.min(millis)
    return df.groupBy(*keys).agg(((F.count("*") - 1) * 1000 / F.when(span > 0, span)).alias("rate"))


def islands(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(keys, value, first, last, n): stretches of equal consecutive values, by the first order column."""
    w = by(keys, *order)
    new = df.withColumn("__new", (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("long"))
    numbered = new.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "__island", value).agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("n")).drop("__island")


def screen(df: DataFrame, keys: list[str], index: str, cursor: Column, rows: int = 24) -> DataFrame:
    """The *rows* places from the cursor, those without an entity as null rows: (keys, slot, index and the rest)."""
    cursors = df.groupBy(*keys).agg(F.min(cursor).alias("__from"))
    wanted = cursors.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("slot"), "__from").withColumn(index, F.col("__from") + F.col("slot")).drop("__from")
    return wanted.join(df, [*keys, index], "left")


def sessions(df: DataFrame, keys: list[str], time: str, gap_seconds: float) -> DataFrame:
    """(keys, session, started, ended, n): a gap of more than *gap_seconds* starts a session."""
    w = by(keys, time)
    apart = F.unix_micros(F.col(time)) - F.unix_micros(F.lag(time).over(w)) > int(gap_seconds * 1_000_000)
    new = df.withColumn("__new", F.coalesce(apart.cast("long"), F.lit(0)))
    numbered = new.withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "session").agg(F.min(time).alias("started"), F.max(time).alias("ended"), F.count("*").alias("n"))


def state_durations(df: DataFrame, keys: list[str], order: list[str], state: str, millis: str) -> DataFrame:
    """Time in each state: from its row to the next one."""
    held = df.withColumn("held", F.lead(millis).over(by(keys, *order)) - F.col(millis))
    return held.groupBy(*keys, state).agg(F.sum("held").alias("ms"), F.count("*").alias("n"))


def changed_rows(df: DataFrame, keys: list[str], order: list[str], columns: list[str], offset: str) -> DataFrame:
    """Rows to show: the first, those with an offset, and those in which a column differs from the row before."""
    w = by(keys, *order)
    test = (F.row_number().over(w) == 1) | (F.coalesce(F.col(offset), F.lit(0)) != 0)
    for c in columns:
        test = test | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    return df.withColumn("__show", test).where("__show").drop("__show")


def stays(pings: DataFrame, viewer: str, time: str, interval_ms: int) -> DataFrame:
    """(viewer, stay, since, until): a viewer's pings as stretches in which none is over before the next."""
    w = by([viewer], time)
    until = F.col(time) + F.expr(f"INTERVAL {interval_ms / 1000:.3f} SECOND")
    late = F.col(time) > F.lag(until).over(w)
    new = pings.select(viewer, time).withColumn("__new", F.coalesce(late.cast("long"), F.lit(0)))
    numbered = new.withColumn("stay", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(viewer, "stay").agg(F.min(time).alias("since"), (F.max(time) + F.expr(f"INTERVAL {interval_ms / 1000:.3f} SECOND")).alias("until"))


def active_changes(pings: DataFrame, viewer: str, time: str, interval_ms: int, ranges: int | None = None) -> DataFrame:
    """(at, change, active): each time at which stays begin or end, by how many more or fewer viewers there are then, and how many from then on.

    A stay counts from its first ping until the interval after its last is over.  Times at which as many come as leave are rows with a change of 0.
    Pings without a time or a viewer count nothing.
    """
    held = stays(pings.where(F.col(viewer).isNotNull() & F.col(time).isNotNull()), viewer, time, interval_ms)
    ends = F.explode(F.array(F.struct(F.col("since").alias("at"), F.lit(1).alias("change")), F.struct(F.col("until").alias("at"), F.lit(-1).alias("change"))))
    changes = held.select(ends.alias("e")).groupBy("e.at").agg(F.sum("e.change").alias("change")).withColumns({"active": F.col("change"), "us": F.unix_micros("at")})
    return running_sum(changes, "active", "us", ranges).select("at", "change", "active")


def active_per_bucket(pings: DataFrame, viewer: str, time: str, interval_ms: int, bucket: str = "1 day") -> DataFrame:
    """(bucket, active): viewers with a stay that touches the stretch of time.

    A stay is dealt to the stretches that it touches, which a range join would compare with all.
    """
    held = stays(pings, viewer, time, interval_ms)
    unit = bucket.split()[-1]
    touched = F.explode(F.sequence(F.date_trunc(unit, "since"), F.date_trunc(unit, "until"), F.expr(f"INTERVAL {bucket}")))
    return held.select(viewer, touched.alias("bucket")).groupBy("bucket").agg(F.countDistinct(viewer).alias("active"))


def frame_durations(df: DataFrame, keys: list[str], order: str, downloaded: str, started: str, ended: str) -> DataFrame:
    """process and whole: how long a frame took from its start and from its download; with the mean and deviation of process over ten frames and the mean of whole over five."""
    w = by(keys, order)
    own = df.withColumns({"process": F.col(ended) - F.col(started), "whole": F.col(ended) - F.col(downloaded)})
    ten, five = w.rowsBetween(-9, 0), w.rowsBetween(-4, 0)
    return own.withColumns({"process_mean": F.avg("process").over(ten), "process_sd": F.stddev_samp("process").over(ten), "whole_mean": F.avg("whole").over(five)})


def turned_to(df: DataFrame, keys: list[str], order: list[str], value: str, wanted: str) -> DataFrame:
    """The rows at which the value becomes *wanted*, having been another before or being the first."""
    before = F.lag(value).over(by(keys, *order))
    return df.withColumn("__before", before).where((F.col(value) == wanted) & ~F.col("__before").eqNullSafe(F.lit(wanted))).drop("__before")
