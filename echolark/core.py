"""Table access and lineage cuts shared by every operator."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: Lists of staged tables, the innermost holder last.
_held: ContextVar[tuple[list[str], ...]] = ContextVar("held", default=())


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` under `sf_dir`, by any path Spark can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. Where none is set, a local session (tests) gets a
    folder of its own; on a cluster a machine's own folder would lose data, so that is an error."""
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"{CHECKPOINT_DIR} names no shared folder")
        folder = tempfile.mkdtemp(prefix="echolark-")
        spark.conf.set(CHECKPOINT_DIR, folder)
    return folder


def staged(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write `df` once to the shared folder and read it back: cuts lineage and survives lost executors.

    Inside scratch() the table goes when the block ends; with `keep` it stays for the block around it,
    and outside of any block until the application ends.
    """
    path = f"{shared_dir(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    hold(df.sparkSession, path, keep)
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hold(spark: SparkSession, path: str, keep: bool = False) -> str:
    """Makes a folder that goes with the block at hand (with `keep`, with the one around it), else with the application."""
    holders = _held.get()[:-1] if keep else _held.get()
    if holders:
        holders[-1].append(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


@contextmanager
def holding(paths: list[str]) -> Iterator[None]:
    """Notes in `paths` what staged() writes meanwhile."""
    token = _held.set((*_held.get(), paths))
    try:
        yield
    finally:
        _held.reset(token)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what staged() wrote meanwhile and was not told to keep."""
    paths: list[str] = []
    try:
        with holding(paths):
            yield
    finally:
        release(spark, paths)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Deletes staged tables that nothing reads any more."""
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Bounds the Arrow batches of long texts, so that Python workers stay small. The setting stays, as
    plans are run after the call; an operator that needs other batches sets its own."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def own_columns(df: DataFrame, name: str = "doc", but: Sequence[str] = ()) -> Column:
    """The columns of df, `but` some, as one struct, where working columns cannot clash with them."""
    return F.struct(*[df[f"`{c}`"] for c in df.columns if c not in but]).alias(name)


def spare(df: DataFrame, name: str) -> str:
    """`name`, made longer until df has no column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def field(struct: str, name: str) -> str:
    """The column reference of a field of a struct."""
    return f"{struct}.`{name}`"


#: Up to so many small rows (an id, a few numbers) one side of a join is sent to every executor.
BROADCAST_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, a staged table of small rows, marked for broadcast if it has at most `rows` of them; larger
    ones are joined by shuffle. Either way the join has the same rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
