"""Prefixes along an order in two levels, so that one key with all rows is still many tasks: first within ranges of the order, then over the ranges' totals.

The borders of ranges are a few quantiles that the driver looks up once; a row's range is then a function of the row, so what is
computed again after a lost task lies where it lay.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ranges at most; a key's ranges are summed up in one task.
MOST_RANGES = 1024
#: How much better than one range the borders are placed.
CLOSER = 20


def borders(df: DataFrame, order: Column, ranges: int | None = None) -> list:
    """Values that part the rows into ranges of like size, as many as the session has shuffle partitions by default; equal values stay together."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, min(n, MOST_RANGES))
    found = df.agg(F.percentile_approx(order, F.array(*(F.lit(i / n) for i in range(1, n))) if n > 1 else F.array(F.lit(1.0)), n * CLOSER)).first()[0]
    return sorted(set(found or []))


def range_of(order: Column, cuts: list) -> Column:
    """The number of cuts that are not above the value, by a search in halves; null goes first."""
    if not cuts:
        return F.lit(0)

    def half(a: int, b: int) -> Column:
        if a == b:
            return F.lit(a)
        mid = (a + b) // 2
        return F.when(order < F.lit(cuts[mid]), half(a, mid)).otherwise(half(mid + 1, b))

    return F.when(order.isNull(), 0).otherwise(half(0, len(cuts)))


def doubled(df: DataFrame, value: str, keys: list[str], order: list[Column | str], rows: int, compose: Callable[[Column, Column], Column]) -> DataFrame:
    """*df* with *value* replaced by the composition of all values up to the row, in order; compose(later, earlier) is associative.

    After each round a row has the composition of twice as many rows, so *rows*, the most rows of a key, need its logarithm of rounds; all use one sort.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    for k in range(math.ceil(math.log2(max(1, rows)))):
        before = F.lag(value, 1 << k).over(w)
        df = df.withColumn("__before", before).withColumn(value, F.when(F.col("__before").isNull(), F.col(value)).otherwise(compose(F.col(value), F.col("__before")))).drop("__before")
    return df


def running_sum(df: DataFrame, value: str, order: str, ranges: int | None = None) -> DataFrame:
    """*df* with *value* replaced by its sum over all rows up to the row, by *order*, which no two rows have alike; no task sees all rows."""
    own = df.withColumn("__range", range_of(F.col(order), borders(df, F.col(order), ranges)))
    totals = own.groupBy("__range").agg(F.sum(value).alias("__total"))
    # As many rows as there are ranges.
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("__range", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__total"))
    within = Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return own.withColumn(value, F.sum(value).over(within)).join(totals, "__range").withColumn(value, F.col(value) + F.col("__total")).drop("__range", "__total")
