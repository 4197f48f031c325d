"""Resampling of PCM between any two whole rates, by a polyphase bank of windowed sinc filters."""

from __future__ import annotations

from functools import lru_cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from echolark.functions.signal import RATE

#: Zero crossings of the sinc on each side, Kaiser's beta (side lobes below -80 dB), and the pass band's part of the lower Nyquist rate.
CROSSINGS, BETA, PASS = 32, 8.0, 0.93
MOST_PHASES, CHUNK = 4096, 1 << 15


@lru_cache(maxsize=64)
def bank(up: int, down: int) -> np.ndarray:
    """Row p: the filter for outputs that lie p / up of a sample behind an input sample; each row sums to one."""
    if up > MOST_PHASES:
        raise ValueError(f"rates need {up} phases, at most {MOST_PHASES} are allowed")
    cut = PASS * min(1.0, up / down)
    half = int(np.ceil(CROSSINGS / cut))
    t = np.arange(-half + 1, half + 1) - np.arange(up)[:, None] / up
    inside = np.clip(1 - (t / half) ** 2, 0, None)
    rows = cut * np.sinc(cut * t) * np.i0(BETA * np.sqrt(inside)) / np.i0(BETA)
    return rows / rows.sum(axis=1, keepdims=True)


def resample(x: np.ndarray, source: int, target: int = RATE) -> np.ndarray:
    """x at the target rate: ceil(n * target / source) values, the first at the time of the first. Values beyond
    the ends count as the end's value."""
    if source <= 0 or target <= 0:
        raise ValueError("rates must be positive")
    x = np.asarray(x, float)
    if source == target or not len(x):
        return x
    common = gcd(source, target)
    up, down = target // common, source // common
    rows = bank(up, down)
    half = rows.shape[1] // 2
    padded = np.pad(x, (half - 1, half), mode="edge")
    windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * half)
    n = -(-len(x) * up // down)
    out = np.empty(n)
    for k in range(0, n, CHUNK):
        at = np.arange(k, min(n, k + CHUNK)) * down
        out[k : k + CHUNK] = np.einsum("ij,ij->i", windows[at // up], rows[at % up])
    return out


def resample_pcm(pcm: bytes, source: int, target: int = RATE) -> bytes:
    """16-bit samples at the target rate; what is beyond 16 bits is clipped."""
    if len(pcm) % 2:
        raise ValueError("PCM must hold whole 16-bit samples")
    y = resample(np.frombuffer(pcm, "<i2").astype(float), source, target)
    return np.clip(np.rint(y), -32768, 32767).astype("<i2").tobytes()


def resampled(pcm: Column, rate: Column) -> Column:
    """PCM of any rate at RATE; null stays null."""

    @F.arrow_udf("binary")
    def convert(pcm: pa.Array, rate: pa.Array) -> pa.Array:
        return pa.array([None if p is None or r is None else resample_pcm(p, r) for p, r in zip(pcm.to_pylist(), rate.to_pylist(), strict=True)], pa.binary())

    return convert(pcm, rate)
