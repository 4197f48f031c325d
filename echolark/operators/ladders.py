"""Verdicts by ladders of rules, times in ISO form, and chunks that are filled up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echolark.core import broadcast_if_small, read_table, staged
from echolark.operators.scoring import THRESHOLDS_SQL, contrastive_rows, contrastive_verdict, thresholds
from echolark.plans.domain import FRAMES_SQL, distances, frames
from echolark.streaming.live import MISMATCH_MARGIN


def ladder(rules: list[tuple[Column, str, str]]) -> tuple[Column, Column]:
    """Status and reason of the first rule that holds; the last one is for all other rows."""
    status, reason = None, None
    for holds, verdict, why in rules[:-1]:
        status = F.when(holds, verdict) if status is None else status.when(holds, verdict)
        reason = F.when(holds, why) if reason is None else reason.when(holds, why)
    return status.otherwise(rules[-1][1]), reason.otherwise(rules[-1][2])


def session_verdict(accept: str = "accept") -> tuple[Column, Column]:
    """The final verdict of rows with duration_ms, voice_ratio, target (null for several words), own (the target's
    distance), nearest, first, second, expected (whether a sentence is expected) and `accept`."""
    missing = F.col("own").isNull() | F.col("second").isNull()
    unsure = F.round(F.col("second") - F.col("first"), 9) < MISMATCH_MARGIN
    absent = F.col("expected") & (F.col(accept).isNull() | (F.col("own") > F.col(accept)))
    return ladder([
        ((F.col("duration_ms") < 400) | (F.col("voice_ratio") < 0.1), "RETRY", "AUDIO_INSUFFICIENT"),
        (F.col("target").isNull(), "REVIEW_REQUIRED", "MULTI_WORD_REVIEW_REQUIRED"),
        (missing, "UNDECIDABLE", "WORD_IDENTITY_UNAVAILABLE"),
        (unsure, "UNDECIDABLE", "WORD_IDENTITY_UNCERTAIN"),
        (absent, "INCORRECT", "TARGET_WORD_NOT_DETECTED"),
        (F.col("nearest") != F.col("target"), "INCORRECT", "WRONG_WORD"),
        (F.col("expected"), "REVIEW_REQUIRED", "PHONETIC_BACKEND_REQUIRED"),
        (F.lit(True), "REVIEW_REQUIRED", "PHONETIC_BACKEND_DISABLED"),
    ])


def final_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every recording as a session at its end: some are short, some silent, some of several words, half expect a sentence."""
    d = staged(distances(spark, sf_dir))
    rank = F.row_number().over(Window.partitionBy("recording_id").orderBy("distance", "candidate"))
    two = d.withColumn("rank", rank).where("rank <= 2").groupBy("recording_id").agg(F.max(F.when(F.col("rank") == 1, F.col("candidate"))).alias("nearest"), F.max(F.when(F.col("rank") == 1, F.col("distance"))).alias("first"), F.max(F.when(F.col("rank") == 2, F.col("distance"))).alias("second"))
    own = d.where("word = candidate").select("recording_id", "word", F.col("distance").alias("own"))
    rows = own.join(two, "recording_id").join(broadcast_if_small(thresholds(d, 0.05).select(F.col("candidate").alias("word"), "accept")), "word")
    k = F.col("recording_id")
    rows = rows.withColumns({"duration_ms": (k % 40 + 1) * 40, "voice_ratio": k % 25 / 24.0, "target": F.when(k % 11 != 0, F.col("word")), "expected": k % 2 == 0})
    status, reason = session_verdict()
    return rows.select("recording_id", "word", "nearest", status.alias("status"), reason.alias("reason"))


def contrastive_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contrastive decisions where recordings of bad quality (one in thirteen) are to be repeated, whatever their distances."""
    status, reason = contrastive_verdict(F.col("recording_id") % 13 == 0)
    return contrastive_rows(spark, sf_dir).select("recording_id", "word", status.alias("status"), reason.alias("reason"))


def iso_time(ts: Column) -> Column:
    """A time as ISO 8601 in UTC, with microseconds where it has any."""
    text = F.date_format(ts.cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts.cast("timestamp_ntz"), "SSSSSS")
    return F.concat(text, F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), F.lit("+00:00"))


def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select("event_id", iso_time(F.col("ts")).alias("at"), F.date_format("ts", "yyyy-MM-dd").alias("day"))


def padded_chunks(spark: SparkSession, sf_dir: str, size: int = 5) -> DataFrame:
    """Chunks of so many frames of each session, the last filled up with silence: frames there, mean level, voiced frames."""
    f = frames(spark, sf_dir).withColumn("chunk", F.floor((F.col("sequence") - 1) / size))
    return f.groupBy("session_id", "chunk").agg(F.count(F.lit(1)).alias("frames"), F.round(F.sum("rms") / size + 1e-9, 6).alias("level"), F.count_if("voice").alias("voiced"))


QUERIES = {f.__name__: f for f in (final_verdicts, contrastive_ladder, iso_times, padded_chunks)}
ORACLE_SQL = {
    "final_verdicts": THRESHOLDS_SQL.format(step=0.05) + f""", r AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY distance, candidate) AS rk FROM dist),
      t AS (SELECT recording_id, max(CASE WHEN rk = 1 THEN candidate END) AS nearest, max(CASE WHEN rk = 1 THEN distance END) AS d1, max(CASE WHEN rk = 2 THEN distance END) AS d2 FROM r GROUP BY 1),
      s AS (SELECT o.recording_id, o.word, nearest, o.distance AS own, d1, d2, accept, (o.recording_id % 40 + 1) * 40 AS ms, o.recording_id % 25 / 24.0 AS voice FROM dist o JOIN t USING (recording_id) JOIN th ON th.candidate = o.word WHERE o.word = o.candidate),
      v AS (SELECT *, CASE WHEN ms < 400 OR voice < 0.1 THEN 'RETRY:AUDIO_INSUFFICIENT' WHEN recording_id % 11 = 0 THEN 'REVIEW_REQUIRED:MULTI_WORD_REVIEW_REQUIRED' WHEN own IS NULL OR d2 IS NULL THEN 'UNDECIDABLE:WORD_IDENTITY_UNAVAILABLE'
        WHEN round(d2 - d1, 9) < {MISMATCH_MARGIN!r} THEN 'UNDECIDABLE:WORD_IDENTITY_UNCERTAIN' WHEN recording_id % 2 = 0 AND (accept IS NULL OR own > accept) THEN 'INCORRECT:TARGET_WORD_NOT_DETECTED' WHEN nearest <> word THEN 'INCORRECT:WRONG_WORD'
        WHEN recording_id % 2 = 0 THEN 'REVIEW_REQUIRED:PHONETIC_BACKEND_REQUIRED' ELSE 'REVIEW_REQUIRED:PHONETIC_BACKEND_DISABLED' END AS v FROM s)
      SELECT recording_id, word, nearest, split_part(v, ':', 1) AS status, split_part(v, ':', 2) AS reason FROM v""",
    "contrastive_ladder": THRESHOLDS_SQL.format(step=0.02) + """, rq AS (SELECT word, round(greatest(0.01, quantile_cont(margin, 0.1)), 9) AS required FROM mm WHERE split = 'validation' GROUP BY word),
      v AS (SELECT recording_id, word, CASE WHEN recording_id % 13 = 0 THEN 'RETRY:AUDIO_QUALITY' WHEN own IS NULL OR own < 0 OR other IS NULL OR other < 0 THEN 'UNDECIDABLE:INVALID' WHEN own <= accept AND margin >= required THEN 'CORRECT:WITHIN_ACCEPT'
        WHEN own >= reject THEN 'INCORRECT:DISTANCE' WHEN margin <= -required THEN 'INCORRECT:MARGIN' ELSE 'UNDECIDABLE:AMBIGUOUS' END AS v FROM mm JOIN th ON th.candidate = mm.word JOIN rq USING (word))
      SELECT recording_id, word, split_part(v, ':', 1) AS status, split_part(v, ':', 2) AS reason FROM v""",
    "iso_times": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE '.' || strftime(ts, '%f') END || '+00:00' AS at, strftime(ts, '%Y-%m-%d') AS day FROM events",
    "padded_chunks": FRAMES_SQL + " SELECT session_id, (sequence - 1) // 5 AS chunk, count(*) AS frames, round(sum(rms) / 5 + 1e-9, 6) AS level, count_if(voice) AS voiced FROM fr GROUP BY 1, 2",
}
