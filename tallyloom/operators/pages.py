"""Pages of read lines: where they lie, how consecutive pages overlap, and entities gathered from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions.similarity import pair_distance

#: Lines of two pages are one line below this distance; an overlap is taken from so many lines on.
SAME_BELOW, LEAST_LINES = 4, 3


def line_divisions(lines: DataFrame, height: float, least_chars: int = 3) -> DataFrame:
    """Lines with ``division``, the place in a column of boxes of that height; only pages with two usable lines or more.

    *lines*: (run_id, page, text, y0, y1, confidence, symbols).  A confidence of 0 becomes half the mean of the symbols'.
    """
    mean = F.aggregate("symbols", F.lit(0.0), lambda a, x: a + x) / (F.size("symbols") * 2)
    usable = lines.where(F.length("text") >= least_chars).withColumn("division", F.floor((F.col("y0") + F.col("y1")) / 2 / height))
    own = usable.withColumn("confidence", F.when(F.col("confidence") == 0, F.coalesce(mean, F.lit(0.0))).otherwise(F.col("confidence").cast("double")))
    return own.withColumn("__n", F.count("*").over(Window.partitionBy("run_id", "page"))).where("__n > 1").drop("__n")


def page_offsets(lines: DataFrame) -> DataFrame:
    """(run_id, page, offset, votes): how far each page has moved on from the one before, where enough lines agree.

    *lines*: (run_id, page, division, text).  Each line votes with its nearest line of the page before.  Pages hold a screen of
    lines at most, so the pairs of two pages are few.
    """
    before = lines.select("run_id", (F.col("page") + 1).alias("page"), F.col("division").alias("old"), F.col("text").alias("old_text"))
    pairs = lines.join(before, ["run_id", "page"]).withColumn("dist", pair_distance("text", "old_text")).where(F.col("dist") < SAME_BELOW)
    nearest = Window.partitionBy("run_id", "page", "division").orderBy("dist", "old")
    votes = pairs.withColumn("rank", F.row_number().over(nearest)).where("rank = 1").groupBy("run_id", "page", (F.col("old") - F.col("division")).alias("offset")).agg(F.count("*").alias("votes"))
    best = Window.partitionBy("run_id", "page").orderBy(F.desc("votes"), F.abs("offset"), "offset")
    return votes.where(F.col("votes") >= LEAST_LINES).withColumn("rank", F.row_number().over(best)).where("rank = 1").drop("rank")


def stitched(lines: DataFrame, offsets: DataFrame) -> DataFrame:
    """Lines with ``place``: the division plus all that the pages up to theirs have moved on."""
    upto = Window.partitionBy("run_id").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    pages = lines.select("run_id", "page").distinct().join(offsets.select("run_id", "page", "offset"), ["run_id", "page"], "left")
    moved = pages.withColumn("moved", F.sum(F.coalesce("offset", F.lit(0))).over(upto)).drop("offset")
    return lines.join(moved, ["run_id", "page"]).withColumn("place", F.col("division") + F.col("moved")).drop("moved")


def gathered(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name, confidence, seen, aliases): the most confident text of each key, the first of equals by text."""
    return lines.groupBy(*keys).agg(F.max_by("text", F.struct("confidence", "text")).alias("name"), F.max("confidence").alias("confidence"), F.count("*").alias("seen"), F.sort_array(F.collect_set("text")).alias("aliases"))
