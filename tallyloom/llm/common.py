"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as in ``[\x20\x09-\x0D]``.
SPACE = b" \t\n\x0b\x0c\r"

#: Rows of a narrow table that is broadcast at most: some tens of megabytes.
MOST_SENT = 2_000_000

#: Maps A-Z to a-z and leaves all other bytes, so UTF-8 stays valid.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table *name* of the data set at *sf_dir*."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    A cluster names it in ``spark.checkpoint.dir``.  Only where that is unset and everything
    runs on this machine, as in tests, a folder of our own is taken.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or "file:///tmp/checkpoints/tallyloom"


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing is written to yet."""
    return f"{shared_dir(spark).rstrip('/')}/settled-{uuid.uuid4().hex}"


def settle(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write *df* once as Parquet in the shared folder and read it back; with a *path*, after what is there.

    This cuts the lineage: a lost executor costs no recomputation of what came
    before, and a table that is used twice is made once.
    """
    spark = df.sparkSession
    path = path or new_path(spark)
    df.write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sent(df: DataFrame) -> DataFrame:
    """*df*, a settled table of one or two narrow columns, to be broadcast if it has no more than MOST_SENT rows; a larger one is joined by a shuffle."""
    return F.broadcast(df) if df.count() <= MOST_SENT else df


def unsettle(df: DataFrame) -> None:
    """Delete the files of a table that :func:`settle` made and nothing needs any more."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)


def each_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """An iterator function for mapInArrow that applies *fn* batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if isinstance(out, pa.Table):
                yield from out.to_batches()
            elif out is not None:
                yield out

    return run


def texts(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, None where it is null."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def free_name(columns: list[str], name: str) -> str:
    """*name*, with underscores before it until none of *columns* has it, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def fold(doc_id: str = "doc_id", parts: int = 5):
    """crc32 of the id as text, modulo *parts*; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts
