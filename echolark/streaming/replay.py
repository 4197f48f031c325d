"""Tables replayed as streams of several micro-batches, and streams run to their end.

A replayed table is written once, in ranges of time, one file a range; files get modification times in
the order of their ranges, and the source reads one file a trigger. A range has about SLICE_ROWS rows, so
triggers stay bounded however long the table is. Real sources bound their triggers the same way, by
files or bytes.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolark.core import hold, read_table, shared_dir

LEAST_SLICES, SLICE_ROWS = 4, 1_000_000


def landed(df: DataFrame, by: str, slices: int | None = None, path: str | None = None) -> str:
    """Writes df as files in the order of column `by` (null first), behind those that the folder has, and returns the folder."""
    spark = df.sparkSession
    slices = slices or max(LEAST_SLICES, -(-df.count() // SLICE_ROWS))
    path = path or hold(spark, f"{shared_dir(spark)}/landed-{uuid.uuid4().hex}")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    there = lambda: {x.getPath().getName(): x for x in files.listStatus(at) if x.getPath().getName().startswith("part-")}
    old = there()
    df.repartitionByRange(slices, F.col(by).asc_nulls_first()).write.mode("append").parquet(path)
    new = sorted(set(there()) - set(old))
    first = max([int(time.time() * 1000) - 1000 * len(new), *(x.getModificationTime() for x in old.values())])
    for k, name in enumerate(new, 1):
        files.setTimes(spark._jvm.org.apache.hadoop.fs.Path(at, name), first + 1000 * k, -1)
    return path


def streamed(spark: SparkSession, path: str, schema) -> DataFrame:
    """The files of a folder as a stream, the oldest first, one a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def replayed(df: DataFrame, by: str, slices: int | None = None) -> DataFrame:
    return streamed(df.sparkSession, landed(df, by, slices), df.schema)


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return replayed(e.withColumn("ts", F.col("ts").cast("timestamp")), "ts")


def drained(stream: DataFrame, mode: str = "append", sink: Callable | None = None, checkpoint: str | None = None, told: list | None = None) -> DataFrame | None:
    """Runs a bounded stream to its end, into a table of the shared folder that is read back, or into
    `sink(batch, id)`. With a checkpoint folder of the caller's, a later run goes on behind the last batch
    that is acknowledged there. `told` gets the progress of each batch."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", checkpoint or hold(spark, f"{path}-log")).outputMode(mode).trigger(availableNow=True)
    writer = writer.foreachBatch(sink) if sink else writer.format("parquet").option("path", hold(spark, path))
    query = writer.start()
    try:
        query.awaitTermination()
    finally:
        if told is not None:
            told += query.recentProgress
    return None if sink else spark.read.schema(stream.schema).parquet(path)


class BatchFolder:
    """A sink that is the same however often a batch is written: each batch has a folder of its own, which
    a batch that comes again after a failure overwrites. What is acknowledged, the checkpoint knows."""

    def __init__(self, path: str):
        self.path = path

    def __call__(self, batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/batch={k}")

    def read(self, spark: SparkSession, schema) -> DataFrame:
        """All rows of the sink, without the batches' numbers."""
        return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(self.path)
