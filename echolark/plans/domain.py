"""Views of the given tables as recordings, distances, frames, logs and clinical records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echolark.core import read_table, staged
from echolark.functions.hashing import unit_interval

DIMS = 26
SEED = "seed"
VOICE_RMS = 0.1
#: Words whose prototypes are compared with every recording (a prototype is DIMS numbers).
MOST_WORDS = 20_000


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id, word, speaker_hash, split and a 26-value feature, one row per embedding."""
    e = read_table(spark, sf_dir, "embeddings")
    speaker = F.sha2(F.concat(F.lit("spk"), (F.col("vec_id") % 97).cast("string")), 256)
    u = unit_interval(F.concat(F.lit(SEED + ":"), F.col("speaker_hash")))
    out = e.select(F.col("vec_id").alias("recording_id"), F.concat(F.lit("w"), F.col("label").cast("string")).alias("word"), speaker.alias("speaker_hash"), F.transform(F.slice("embedding", 1, DIMS), lambda x: x.cast("double")).alias("feature"))
    return out.withColumn("split", F.when(u < 0.8, "train").when(u < 0.9, "validation").otherwise("test"))


def prototypes(recs: DataFrame) -> DataFrame:
    """One mean feature per word over training rows; the vocabulary bounds its size."""
    return recs.where("split = 'train'").groupBy(F.col("word").alias("candidate")).agg(F.array(*[F.avg(F.col("feature")[i]) for i in range(DIMS)]).alias("prototype"))


def checked_prototypes(recs: DataFrame) -> DataFrame:
    """prototypes, staged; more than MOST_WORDS of them are refused, as every executor gets all."""
    found = staged(prototypes(recs))
    if found.limit(MOST_WORDS + 1).count() > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} words")
    return found


def euclid(a: Column, b: Column) -> Column:
    """Root mean squared difference of two arrays of one length."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(total / F.size(a))


def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of every recording to every word's prototype, to nine places."""
    recs = recordings(spark, sf_dir)
    found = recs.crossJoin(F.broadcast(checked_prototypes(recs)))
    return found.select("recording_id", "word", "speaker_hash", "split", "candidate", F.round(euclid(F.col("feature"), F.col("prototype")), 9).alias("distance"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames of a session: sequence by time, rms from the value."""
    from pyspark.sql import Window

    e = read_table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("session_id"), "event_id", F.row_number().over(order).alias("sequence"), (F.col("value") / 500.0).alias("rms"), ((F.col("value") / 500.0) >= VOICE_RMS).alias("voice"))


STATUS = {"purchase": "CORRECT", "error": "INCORRECT", "view": "UNDECIDABLE", "click": "RETRY", "signup": "REVIEW_REQUIRED"}


def decision_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    status = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in STATUS.items()])
    return e.select(F.col("event_id").alias("attempt_id"), F.col("user_id").alias("session_id"), status.alias("status"), F.col("value").alias("latency"), "props", "ts")


REC_SQL = """
WITH rec AS (
  SELECT vec_id AS recording_id, 'w' || label AS word, sha256('spk' || (vec_id % 97)) AS speaker_hash,
         list_transform(embedding[1:26], lambda x: x::DOUBLE) AS feature FROM embeddings),
spl AS (
  SELECT *, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'validation' ELSE 'test' END AS split
  FROM (SELECT *, ('0x' || substr(sha256('seed:' || speaker_hash), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 AS u FROM rec)),
lng AS (SELECT recording_id, word, speaker_hash, split, unnest(range(1, 27)) AS d, unnest(feature) AS x FROM spl)
"""
DIST_SQL = REC_SQL + """,
proto AS (SELECT word AS candidate, d, avg(x) AS m FROM lng WHERE split = 'train' GROUP BY 1, 2),
dist AS (
  SELECT l.recording_id, l.word, l.speaker_hash, l.split, p.candidate, round(sqrt(sum((l.x - p.m) * (l.x - p.m)) / 26), 9) AS distance
  FROM lng l JOIN proto p USING (d) GROUP BY ALL)
"""
FRAMES_SQL = "WITH fr AS (SELECT user_id AS session_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence, value / 500.0 AS rms, value / 500.0 >= 0.1 AS voice FROM events)"
LOGS_SQL = "WITH lg AS (SELECT event_id AS attempt_id, user_id AS session_id, CASE event_type WHEN 'purchase' THEN 'CORRECT' WHEN 'error' THEN 'INCORRECT' WHEN 'view' THEN 'UNDECIDABLE' WHEN 'click' THEN 'RETRY' WHEN 'signup' THEN 'REVIEW_REQUIRED' END AS status, value AS latency, props, ts FROM events)"
