"""Aggregates over repeated readings of entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def online_statistics(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """count, mean, sum, sample deviation and population variance; null where there are too few values."""
    v = F.col(value)
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.sum(v).alias("total"), F.stddev_samp(v).alias("sd"), F.var_pop(v).alias("variance"))


def best_reading(df: DataFrame, keys: list[str], text: str, confidence: str, order: str) -> DataFrame:
    """Of each entity the text of the highest confidence over 0, the first of equals, even where it is null; and all texts seen.

    One pre-aggregated pass; the set of texts is the only state that grows with the readings' variety.
    """
    seen = F.struct(F.col(confidence).alias("c"), (-F.col(order)).alias("o"))
    return df.groupBy(*keys).agg(
        F.max_by(F.col(text), F.when(F.col(confidence) > 0, seen)).alias("name"),
        F.coalesce(F.max(F.when(F.col(confidence) > 0, F.col(confidence))), F.lit(0)).alias("confidence"),
        F.sort_array(F.collect_set(text)).alias("aliases"),
    )


def known_and_last(df: DataFrame, keys: list[str], name: str, length: str, index: str) -> DataFrame:
    """Known names, and the last index with a length, -1 if none."""
    return df.groupBy(*keys).agg(F.count(name).alias("known"), F.coalesce(F.max(F.when(F.col(length).isNotNull(), F.col(index))), F.lit(-1)).alias("last_index"))


def score_histogram(df: DataFrame, score: str) -> DataFrame:
    return df.groupBy(score).agg(F.count("*").alias("n"))


def mean_per_distinct_score(histogram: DataFrame, score: str) -> DataFrame:
    """Sum of the scores over the number of distinct scores, and the plain mean beside it."""
    total = F.sum(F.col(score) * F.col("n"))
    return histogram.agg((total / F.count("*")).alias("per_distinct"), (total / F.sum("n")).alias("mean"))


def keep_best_images(df: DataFrame, key: str, confidence: str, order: str, k: int = 3) -> DataFrame:
    """At most k rows an entity, the most confident first, then the first."""
    by = Window.partitionBy(key).orderBy(F.desc(confidence), order)
    return df.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def ready_to_read(length: Column, busy: Column, confidence: Column, least: float = 85) -> Column:
    return length.isNotNull() & ~busy & (confidence < least)


def first_usable_line(df: DataFrame, key: str, line_no: str, text: str, least: int = 4) -> DataFrame:
    """The first line of at least *least* characters, measured before it is trimmed."""
    by = Window.partitionBy(key).orderBy(line_no)
    kept = df.where(F.length(text) >= least).withColumn("rank", F.row_number().over(by)).where("rank = 1").drop("rank")
    return kept.withColumn(text, F.trim(text))


def alias_length_gaps(df: DataFrame, key: str, alias: str, order: str, least: int = 3) -> DataFrame:
    """(key, first, second, gap): pairs of one entity's aliases, in the order in which they came, of which the first is over *least* letters longer.

    An alias came with its least *order*; of equals the first by code points.  Entities have few aliases; the pairs are made inside the row of the entity, never by a join of rows.
    """
    came = df.where(F.col(alias).isNotNull()).groupBy(key, alias).agg(F.min(order).alias("came"))
    sets = came.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("came", F.col(alias).alias("alias")))), lambda x: x["alias"]).alias("a"))
    pairs = F.flatten(F.transform("a", lambda x, i: F.transform(F.filter("a", lambda _, j: j > i), lambda y: F.struct(x.alias("first"), y.alias("second"), (F.length(x) - F.length(y)).alias("gap")))))
    return sets.select(key, F.explode(pairs).alias("p")).select(key, "p.*").where(F.col("gap") > least)


def unverified(name: Column, confidence: Column, least: float = 0.5) -> Column:
    """Whether a reading has no name or hardly any confidence (of 100)."""
    return name.isNull() | F.coalesce(confidence < least, F.lit(True))


def line_confidence(word_confidence: Column, letters: Column) -> Column:
    """The greater of a word's confidence and its letters' mean over 1.3."""
    total = F.aggregate(letters, F.lit(0.0), lambda a, x: a + x)
    return F.greatest(word_confidence.cast("double"), total / (F.size(letters) * 1.3))
