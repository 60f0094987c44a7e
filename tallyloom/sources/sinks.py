"""What a run leaves behind: its log, its entities as JSON, its frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entity_json(name: Column, length: Column, index: Column, confidence: Column, aliases: Column, entered: Column, left: Column, images: Column) -> Column:
    """An entity as JSON; its time on screen is without end while it hasn't left."""
    stay = F.when(left.isNotNull(), (left - entered).cast("double")).otherwise(F.lit(float("inf")))
    return F.to_json(F.struct(name.alias("name"), length.alias("len"), index.alias("index"), confidence.alias("conf"), aliases.alias("aliases"), entered.alias("enterTime"), left.alias("debugExitTime"), stay.alias("timeOnScreen"), images.alias("img_files")))


def _millis(column: str, unknown: str) -> Column:
    return F.when(F.col(column).isNotNull(), F.format_string("%.2f ms", F.col(column).cast("double"))).otherwise(F.lit(unknown))


def log_text(log: DataFrame, timing: DataFrame | None = None) -> DataFrame:
    """(run_id, frame_id, value): a block of text for each frame of a tracker's log.

    *timing*: (run_id, frame_id, process), milliseconds; with it each block ends with the frame's time.
    """
    parts = [F.concat(F.lit("seen     "), "shown"), F.concat(F.lit("expected "), "expected"), F.concat(F.lit("found    "), F.to_json(F.struct("frame_id", "offset", "good", "by", "first_index")))]
    if timing is not None:
        log = log.join(timing.select("run_id", "frame_id", "process"), ["run_id", "frame_id"], "left")
        parts.append(F.format_string("frame %d took %s", "frame_id", _millis("process", "?")))
    return log.select("run_id", "frame_id", F.concat_ws("\n", *parts).alias("value"))


def write_log(log: DataFrame, path: str, timing: DataFrame | None = None) -> None:
    """One folder a run, in frame order within a file."""
    log_text(log, timing).repartition("run_id").sortWithinPartitions("run_id", "frame_id").select("run_id", "value").write.mode("overwrite").partitionBy("run_id").text(path)


def write_entities(entities: DataFrame, path: str) -> None:
    entities.write.mode("overwrite").json(path)


def write_frames(frames: DataFrame, path: str, checkpoint: str):
    """Append each batch of a stream of (run_id, image_no, image) to a table by run; gives the running query."""

    def each(batch: DataFrame, _: int) -> None:
        batch.write.mode("append").partitionBy("run_id").parquet(path)

    return frames.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def timing_means(checks: DataFrame) -> DataFrame:
    """(run_id, value): the mean time of each kind of check as text.  *checks*: (run_id, kind, ms), kind "color", "quick" or "length"."""
    named = {"color": "colour", "quick": "quick look", "length": "length"}
    means = checks.groupBy("run_id").agg(*(F.avg(F.when(F.col("kind") == k, F.col("ms"))).alias(k) for k in named))
    lines = [F.concat(F.lit(f"mean of a {text} check: "), _millis(k, "-")) for k, text in named.items()]
    return means.select("run_id", F.concat_ws("\n", *lines).alias("value"))


def payload(image: Column) -> Column:
    """An image as text, for a recogniser that is called by JSON."""
    return F.base64(image)


def from_payload(text: Column) -> Column:
    return F.unbase64(text)
