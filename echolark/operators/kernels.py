"""Warping distances, prototypes and features of recordings as Arrow-batched UDFs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolark.core import read_table
from echolark.functions.resampling import resample_pcm
from echolark.functions.signal import dtw_distances, mfcc_summary, mfcc_temporal, signal_stats, subsequence_distances
from echolark.operators.warped_medoids import FRAME_DIMS, warped_medoids
from echolark.plans.domain import MOST_WORDS, recordings

PAIRS = 2_000


def temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings with their values as 16 frames of 4."""
    e = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("recording_id"), "embedding")
    return recordings(spark, sf_dir).drop("feature").join(e, "recording_id")


def _matrix(x) -> np.ndarray:
    return np.asarray(x, float).reshape(-1, FRAME_DIMS)


def _by_shape(f, a: pd.Series, b: pd.Series) -> pd.Series:
    """f of a batch of pairs, those of one shape together, PAIRS at a time."""
    left, right, out = [_matrix(x) for x in a], [_matrix(x) for x in b], np.zeros(len(a))
    shapes: dict[tuple, list[int]] = {}
    for k, (x, y) in enumerate(zip(left, right, strict=True)):
        shapes.setdefault((x.shape, y.shape), []).append(k)
    for at in shapes.values():
        for k in range(0, len(at), PAIRS):
            part = at[k : k + PAIRS]
            out[part] = f(np.stack([left[i] for i in part]), np.stack([right[i] for i in part]))
    return pd.Series(out)


def _warped(a: pd.Series, b: pd.Series) -> pd.Series:
    """Warped distances of a batch of pairs."""
    return _by_shape(dtw_distances, a, b)


def _sought(a: pd.Series, b: pd.Series) -> pd.Series:
    """Least distances of a batch of prototypes to windows of their sequences."""
    return _by_shape(subsequence_distances, a, b)


def medoid_prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to four medoids of each word by warped distance among all its training rows, staged."""
    return warped_medoids(temporal(spark, sf_dir).where("split = 'train'"))


def checked_medoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """medoid_prototypes; those of more than MOST_WORDS words are refused, as every executor gets all."""
    found = medoid_prototypes(spark, sf_dir)
    if found.select("word").distinct().limit(MOST_WORDS + 1).count() > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} words")
    return found


def dtw_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest word of each validation recording by warped distance to any of its medoids."""
    p = checked_medoids(spark, sf_dir).select(F.col("word").alias("candidate"), F.col("embedding").alias("prototype"))
    v = temporal(spark, sf_dir).where("split = 'validation'").select("recording_id", "word", "embedding")
    d = v.crossJoin(F.broadcast(p)).withColumn("d", F.pandas_udf(_warped, "double")("embedding", "prototype"))
    best = d.groupBy("recording_id", "word", "candidate").agg(F.min("d").alias("d")).groupBy("recording_id", "word").agg(F.min(F.struct("d", "candidate")).alias("b"))
    return best.select("recording_id", "word", F.col("b.candidate").alias("nearest"), F.round("b.d", 6).alias("distance"))


def subsequence_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each test recording's least distance to the middle half of any of its word's medoids."""
    p = checked_medoids(spark, sf_dir).select("word", F.slice("embedding", 17, 32).alias("prototype"))
    v = temporal(spark, sf_dir).where("split = 'test'").select("recording_id", "word", "embedding")
    d = v.join(F.broadcast(p), "word").withColumn("d", F.pandas_udf(_sought, "double")("prototype", "embedding"))
    return d.groupBy("recording_id", "word").agg(F.round(F.min("d"), 6).alias("distance"))


def audio(values: list[float]) -> bytes:
    """A row's values as 16 kHz samples: each gives a stretch of its own length, loudness and pitch."""
    v = np.nan_to_num(np.asarray(values, float))
    sizes = 40 + (np.abs(v) * 4_000).astype(int) % 160
    loud = np.repeat(np.clip(np.abs(v) * 2, 0, 1), sizes)
    phase = np.cumsum(np.repeat(2 * np.pi * (200 + 1_500 * np.abs(v) % 1_800) / 16_000, sizes))
    return (loud * np.sin(phase) * 32767).astype("<i2").tobytes()


#: Recordings whose audio a task works on at once.
SLICE = 256


def in_slices(it: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows of all batches, SLICE at once: audio is far larger than the values it is made of."""
    for b in it:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def mfcc_of(pcm: bytes) -> tuple[np.ndarray | None, int]:
    """Summary features and number of frames of audio; none where it is silent."""
    if not len(pcm) or not np.frombuffer(pcm, "<i2").astype(float).std() > 1:
        return None, 0
    return mfcc_summary(pcm), len(mfcc_temporal(pcm))


def mfcc_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary features and frame count of every recording's audio; silent ones have none."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(it):
            found = [mfcc_of(audio(x)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f for f, _ in found], pa.list_(pa.float32())), pa.array([n for _, n in found], pa.int32())], names=["recording_id", "feature", "frames"])

    rows = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("recording_id"), "embedding")
    return rows.mapInArrow(batches, "recording_id long, feature array<float>, frames int")


RATES = (44_100, 8_000, 16_000)


def resampled_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every recording's audio, taken to be of 44.1, 8 or 16 kHz by its id, at 16 kHz: samples before and after,
    and the statistics of the result."""
    rows = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("recording_id"), "embedding")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(it):
            ids, found = b.column(0).to_pylist(), []
            for i, values in zip(ids, b.column(1).to_pylist(), strict=True):
                pcm = audio(values)
                new = resample_pcm(pcm, RATES[i % 3])
                now = signal_stats(new)
                found.append((i, RATES[i % 3], len(pcm) // 2, len(new) // 2, *(round(now[k], 4) for k in ("duration_s", "rms_dbfs", "peak_dbfs", "clipped_ratio"))))
            yield pa.RecordBatch.from_pylist([dict(zip(RESAMPLED, r, strict=True)) for r in found], schema=pa.schema(list(zip(RESAMPLED, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.float64()] * 4), strict=True))))

    return rows.mapInArrow(batches, "recording_id long, rate int, samples_in long, samples_out long, duration_s double, rms_dbfs double, peak_dbfs double, clipped_ratio double")


RESAMPLED = ("recording_id", "rate", "samples_in", "samples_out", "duration_s", "rms_dbfs", "peak_dbfs", "clipped_ratio")
QUERIES = {f.__name__: f for f in (medoid_prototypes, dtw_nearest, subsequence_nearest, mfcc_features, resampled_audio)}
ORACLE_SQL: dict[str, str] = {}
