"""Readings that come back later than they were asked for, joined with the frames that asked: over streams, or tables alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

READ, UNREAD, LATE = "read", "unread", "late"


def met_readings(jobs: DataFrame, readings: DataFrame, keys: list[str], asked: str, came: str, timeout: str = "5 seconds", late: str = "10 seconds") -> DataFrame:
    """Every job with each reading that came within *timeout* of it ("read"), a job without one ("unread"), and a reading without such a job ("late"): (keys, the others of both, status).

    *keys* name a job; null ones meet nothing.  A stream tells a reading at once, and that a job stays unread or a reading is late once the watermarks of both sides, *late* behind, say that nothing can
    come any more; then it keeps neither.  Apart from the keys no name may be in both.
    """
    left, right = jobs.withWatermark(asked, late), readings.withWatermark(came, late)
    theirs = {k: f"__{k}" for k in keys}
    right = right.withColumnsRenamed(theirs)
    test = (F.col(came) >= F.col(asked)) & (F.col(came) <= F.col(asked) + F.expr(f"INTERVAL {timeout}"))
    for k, other in theirs.items():
        test = test & (F.col(k) == F.col(other))
    both = left.join(right, test, "fullOuter")
    status = F.when(F.col(asked).isNull(), LATE).when(F.col(came).isNull(), UNREAD).otherwise(READ)
    return both.select(*(F.coalesce(F.col(k), F.col(o)).alias(k) for k, o in theirs.items()), *(c for c in jobs.columns if c not in keys), *(c for c in readings.columns if c not in keys), status.alias("status"))


def job_counts(met: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, read, unread, late) of what met_readings tells, as a table."""
    return met.groupBy(*keys).agg(*(F.count(F.when(F.col("status") == s, 1)).alias(s) for s in (READ, UNREAD, LATE)))
