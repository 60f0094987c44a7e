"""What the service answers, as functions that give DataFrames: status, search, entities, images, the accuracy report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.operators import readings, reconcile, search, windows

find = search.find


def status(log: DataFrame, entities: DataFrame, timing: DataFrame, pings: DataFrame, interval_ms: int = 2000, fps: float = 30) -> DataFrame:
    """One row a run: state, last glyph strings, entities with a name, lag to live, mean reading time, viewers of all time and active ones.

    *log*: of the tracker; *entities*: (run_id, name, ocr_ms); *timing*: (run_id, ms); *pings*: (run_id, ip, ts).
    """
    last = log.groupBy("run_id").agg(F.max_by(F.struct("status", "shown", "expected"), "frame_id").alias("s")).select("run_id", F.col("s.status").alias("state"), F.col("s.shown").alias("screen_state"), F.col("s.expected").alias("appear_state"))
    named = entities.groupBy("run_id").agg(F.count("name").alias("known"), F.count("*").alias("users"), F.avg("ocr_ms").alias("lag_time"))
    late = windows.lag_to_expected(timing, ["run_id"], "ms", fps).withColumnRenamed("lag", "lag_to_live")
    # A viewer is active if a ping's interval reaches the last ping of the run.
    newest = pings.groupBy("run_id", "ip").agg(F.max("ts").alias("ts"))
    ends = newest.groupBy("run_id").agg(F.max("ts").alias("end"))
    held = newest.join(ends, "run_id").withColumn("active", F.unix_millis("end") - F.unix_millis("ts") <= interval_ms)
    viewers = held.groupBy("run_id").agg(F.count("*").alias("all_viewers"), F.count(F.when(F.col("active"), 1)).alias("viewers"))
    out = last
    for part in (named, late, viewers):
        out = out.join(part, "run_id", "left")
    return out


def user_list(entities: DataFrame) -> DataFrame:
    """(run_id, user_idx, name), in order within a run's file."""
    return entities.select("run_id", "user_idx", "name").repartition("run_id").sortWithinPartitions("run_id", "user_idx")


def image_by_name(entities: DataFrame, name: str) -> DataFrame:
    return entities.where(F.array_contains("aliases", name) | (F.col("name") == name)).select("run_id", "user_idx", "best_img")


def image_by_index(entities: DataFrame, user_idx: int, picture: int | None = None) -> DataFrame:
    """The best image of an entity, or the n-th of those kept; null where there is none."""
    image = F.col("best_img") if picture is None else F.get("images", F.lit(picture))
    return entities.where(F.col("user_idx") == user_idx).select("run_id", "user_idx", image.alias("image"))


def accuracy_report(external: DataFrame, tracked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(report, stretches of one offset, rows of the walk)."""
    rows = reconcile.reconcile(external, tracked)
    return reconcile.report(rows), reconcile.offset_stretches(rows), rows


def last_lengths(entities: DataFrame, n: int = 24) -> DataFrame:
    """(run_id, lengths): of the last n entities, in order.  Only these are put together, so a run of any length is n rows in its task."""
    last = Window.partitionBy("run_id").orderBy(F.desc("user_idx"))
    kept = entities.select("run_id", "user_idx", "length", F.row_number().over(last).alias("place")).where(F.col("place") <= n)
    own = F.array_sort(F.collect_list(F.struct(-F.col("place"), "length")))
    return kept.groupBy("run_id").agg(F.transform(own, lambda x: x["length"]).alias("lengths"))


#: Letters that a search must have.
LEAST_LETTERS = 3


def find_name(entities: DataFrame, text: str, k: int = 5, threshold: float = 12) -> DataFrame | None:
    """As find, for what a viewer typed: nothing is searched (None) for blanks or fewer than LEAST_LETTERS letters."""
    text = (text or "").strip()
    return search.find(entities, [text], k, threshold) if len(text) >= LEAST_LETTERS else None


def reading_status(entities: DataFrame) -> DataFrame:
    """(run_id, users, known, unverified, images, has_name): the tracker's counts, and whether each entity, in order, has a name.

    *entities*: (run_id, user_idx, name, confidence, images).
    """
    named = F.transform(F.array_sort(F.collect_list(F.struct("user_idx", F.col("name").isNotNull().alias("has")))), lambda x: x["has"])
    open_ = F.count(F.when(readings.unverified(F.col("name"), F.col("confidence")), 1))
    return entities.groupBy("run_id").agg(F.count("*").alias("users"), F.count("name").alias("known"), open_.alias("unverified"), F.sum(F.coalesce(F.size("images"), F.lit(0))).alias("images"), named.alias("has_name"))
