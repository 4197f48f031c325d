"""Frame sessions: limits, windows and summaries in batch, and deduplication of a stream."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echolark.core import read_table
from echolark.plans.domain import FRAMES_SQL, frames
from echolark.streaming.replay import drained, events_stream

LIMIT, WINDOW_S = 20, 86_400


def judged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """user_id, event_id and whether each event passes, of batches in order of user and time; at most
    LIMIT passes of the user at hand are kept, over batches of any number."""
    user, log = object(), deque()
    for b in batches:
        passed = []
        for u, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            if u != user:
                user, log = u, deque()
            while t is not None and log and log[0] <= t - WINDOW_S * 1_000_000:
                log.popleft()
            passed.append(len(log) < LIMIT)
            if passed[-1]:
                log.append(t)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(passed, pa.bool_())], names=["user_id", "event_id", "allowed"])


def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding log per user: an event passes if fewer than LIMIT passed in the last WINDOW_S seconds.

    Whether one passes depends on earlier passes, so each user's events are read in order, in batches,
    with the log of passes as state; events without a time come last.
    """
    e = read_table(spark, sf_dir, "events").select(F.col("user_id").cast("long"), F.col("event_id").cast("long"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    e = e.repartition("user_id").sortWithinPartitions("user_id", F.asc_nulls_last("t"), F.asc_nulls_last("event_id"))
    return e.mapInArrow(judged, "user_id long, event_id long, allowed boolean")


def session_summary(f: DataFrame) -> DataFrame:
    """Final status of each session by voiced share and level."""
    g = f.groupBy("session_id").agg(F.count(F.lit(1)).alias("frames"), F.count_if("voice").alias("voiced"), F.max("sequence").alias("last"))
    ratio = F.col("voiced") / F.col("frames")
    return g.select("session_id", "frames", "voiced", F.when(F.col("frames") * 40 < 400, "RETRY").when(ratio < 0.1, "RETRY").when(F.col("frames") > 375, "REVIEW_REQUIRED").otherwise("SCORED").alias("status"))


def session_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_summary(frames(spark, sf_dir))


def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event per attempt as the stream brings them, within a watermark of an hour."""
    s = events_stream(spark, sf_dir).withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["event_id"])
    return drained(s.select("event_id", "user_id", "event_type"))


def tumbling_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-frame chunks by count: level and voice of each whole chunk."""
    f = frames(spark, sf_dir).withColumn("chunk", F.floor((F.col("sequence") - 1) / 5))
    return f.groupBy("session_id", "chunk").agg(F.count(F.lit(1)).alias("frames"), F.count_if("voice").alias("voiced")).where("frames = 5")


def stable_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame at which each session's first voice is 240 ms old: one update a session."""
    f = frames(spark, sf_dir)
    first = F.min(F.when(F.col("voice"), F.col("sequence"))).over(Window.partitionBy("session_id"))
    return f.withColumn("first", first).where("sequence = first + 6").select("session_id", "sequence", "event_id")


QUERIES = {f.__name__: f for f in (rate_limit, session_final, stream_dedupe, tumbling_chunks, stable_updates)}
ORACLE_SQL = {
    "session_final": FRAMES_SQL + " SELECT session_id, count(*) AS frames, count_if(voice) AS voiced, CASE WHEN count(*) * 40 < 400 OR count_if(voice) / count(*) < 0.1 THEN 'RETRY' WHEN count(*) > 375 THEN 'REVIEW_REQUIRED' ELSE 'SCORED' END AS status FROM fr GROUP BY 1",
    "stream_dedupe": "SELECT DISTINCT event_id, user_id, event_type FROM events",
    "tumbling_chunks": FRAMES_SQL + " SELECT session_id, (sequence - 1) // 5 AS chunk, count(*) AS frames, count_if(voice) AS voiced FROM fr GROUP BY 1, 2 HAVING count(*) = 5",
    "stable_updates": FRAMES_SQL + ", f AS (SELECT *, min(CASE WHEN voice THEN sequence END) OVER (PARTITION BY session_id) AS v FROM fr) SELECT session_id, sequence, event_id FROM f WHERE sequence = v + 6",
}
