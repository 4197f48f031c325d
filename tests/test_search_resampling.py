"""Threshold search against planted optima, and resampling of tones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from echolark.functions.resampling import resample, resample_pcm, resampled
from echolark.operators import search


def test_gaussian_functions():
    assert search.normal_cdf(np.array([0.0, 1.959963985, -1.959963985])) == pytest.approx([0.5, 0.975, 0.025], abs=1e-9)
    assert search.normal_pdf(np.array([0.0, 1.0])) == pytest.approx([0.3989422804, 0.2419707245])
    rng = np.random.default_rng(1)
    draws = rng.normal(0.3, 0.7, 400_000)
    assert search.expected_gain(np.array([0.3]), np.array([0.7]), 0.1)[0] == pytest.approx(np.maximum(0.1 - draws, 0).mean(), abs=3e-3)


def test_search_finds_a_planted_optimum_and_repeats():
    asked = []

    def bowl(points):
        asked.append(len(points))
        return ((points - [0.3, -2.0]) ** 2 / [1, 16]).sum(axis=1)

    found = search.minimised(bowl, [(-1, 1), (-4, 4)], seed=3)
    assert found.value < 2e-3 and found.judged == 80 and asked == [8] * 10
    assert found == search.minimised(bowl, [(-1, 1), (-4, 4)], seed=3)
    rng = np.random.default_rng(3)
    drawn = bowl(np.stack([rng.uniform(-1, 1, 80), rng.uniform(-4, 4, 80)], axis=1)).min()
    assert found.value < drawn / 3


def test_bounds_and_values_are_checked():
    for bounds in ([], [(1, 1)], [(0, float("inf"))]):
        with pytest.raises(ValueError):
            search.minimised(lambda p: p[:, 0], bounds)
    with pytest.raises(ValueError, match="finite"):
        search.minimised(lambda p: p[:, 0] * np.nan, [(0, 1)])


def test_thresholds_planted_in_rows_are_found(spark):
    rows = spark.range(20_000).select((F.rand(1) * 4).alias("x"), F.rand(2).alias("y"))
    rows = rows.withColumn("good", (F.col("x") >= 1.7) & (F.col("y") >= 0.35)).cache()
    found = search.minimised(lambda p: search.decision_cost(rows, p, search.two_limits), [(0, 4), (0, 1), (0, 0.5)], seed=1)
    assert found.value < 0.12 and abs(found.point[0] - 1.7) < 0.25 and abs(found.point[1] - 0.35) < 0.08
    data = rows.toPandas()
    a, b, m = found.point
    accepted = (data.x >= a) & (data.y >= b)
    rejected = ~accepted & ((data.x < a - m) | (data.y < b - m))
    cost = (accepted & ~data.good).sum() / (~data.good).sum() + (rejected & data.good).sum() / data.good.sum() + 0.3 * (~accepted & ~rejected).mean()
    assert found.value == pytest.approx(cost)
    rows.unpersist()


def level(x, hz, rate=16_000):
    """Level in dB of one frequency in the middle of x."""
    x = x[len(x) // 5 : -len(x) // 5]
    w = np.hanning(len(x))
    return 20 * np.log10(abs((x * w * np.exp(-2j * np.pi * hz * np.arange(len(x)) / rate)).sum()) * 2 / w.sum() + 1e-12)


@pytest.mark.parametrize("rate", [44_100, 48_000, 22_050, 8_000, 11_025])
def test_tones_keep_frequency_and_level(rate):
    for hz in (100, 1000, 3300):
        x = np.sin(2 * np.pi * hz * np.arange(rate) / rate)
        y = resample(x, rate)
        assert len(y) == 16_000 and abs(level(y, hz)) < 0.05
        peak = np.abs(np.fft.rfft(y * np.hanning(len(y)))).argmax()
        assert peak == hz
    assert resample(np.ones(rate), rate) == pytest.approx(np.ones(16_000))


def test_what_would_alias_is_gone():
    for rate, tones in ((44_100, (8_700, 11_000, 15_000, 21_000)), (48_000, (9_000, 20_000))):
        for hz in tones:
            y = resample(np.sin(2 * np.pi * hz * np.arange(rate) / rate), rate)
            inner = y[2000:-2000]
            assert 20 * np.log10(np.sqrt(2 * np.mean(inner * inner)) + 1e-12) < -60, (rate, hz)
    # and images of a lower rate are not there
    y = resample(np.sin(2 * np.pi * 1000 * np.arange(8000) / 8000), 8_000)
    assert level(y, 7000) < -60 and level(y, 1000) == pytest.approx(0, abs=0.05)


def test_odd_audio(spark):
    assert resample_pcm(b"", 44_100) == b"" and len(resample_pcm(b"\1\0", 8_000)) == 4
    loud = np.tile([32767, -32768], 4000).astype("<i2").tobytes()
    assert len(resample_pcm(loud, 8_000)) == 2 * len(loud)
    for bad in ((b"\1", 8_000), (b"\1\0", 0), (b"\1\0" * 9, 15_999)):
        with pytest.raises(ValueError):
            resample_pcm(*bad)
    df = spark.createDataFrame([(bytearray(loud), 8_000), (None, 8_000), (bytearray(loud), None)], "pcm binary, rate int")
    out = [r.y for r in df.select(resampled(F.col("pcm"), F.col("rate")).alias("y")).collect()]
    assert len(out[0]) == 2 * len(loud) and out[1:] == [None, None]
