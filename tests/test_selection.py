"""Exact quantiles by counting, and representatives, against NumPy and plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from echolark.operators import medoids, scoring, selection


def spread(rng):
    yield "normal", rng.normal(size=3000)
    yield "equal", np.full(2500, 4.25)
    yield "two values", rng.choice([1.0, 1.0 + 1e-12], 2100)
    yield "orders", 10.0 ** rng.integers(-12, 12, 2200)
    yield "extremes", np.concatenate([rng.normal(size=1500), [1.7e308, -1.7e308, 5e-324, -0.0, 0.0]])
    yield "ties", np.round(rng.normal(size=4000), 1)
    yield "one", np.array([7.5])
    yield "two", np.array([3.0, -3.0])


@pytest.mark.parametrize("few", [50, 10**6])
def test_quantiles_are_numpys(spark, few):
    rng = np.random.default_rng(8)
    groups = dict(spread(rng))
    rows = [(k, float(x)) for k, v in groups.items() for x in v]
    rows += [("normal", None), ("normal", float("nan")), ("equal", float("inf")), ("nothing", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "name string, x double").repartition(4)
    shares = {"a": 0.0, "b": 0.37, "c": 1.0}
    got = {r.name: r for r in selection.exact_quantiles(df, "name", "x", shares, few).collect()}
    assert set(got) == set(groups)
    for k, v in groups.items():
        for name, p in shares.items():
            i = p * (len(v) - 1)
            low, high = np.sort(v)[[int(np.floor(i)), int(np.ceil(i))]]
            assert got[k][name] == pytest.approx(low + (high - low) * (i - np.floor(i)), rel=1e-12), (k, name)
    assert selection.exact_quantiles(df.limit(0), "name", "x", shares, few).count() == 0


def test_lists_stay_bounded(spark, monkeypatch):
    sizes, list_of = [], F.collect_list
    monkeypatch.setattr(selection.F, "collect_list", lambda c: sizes.append(c) or list_of(c))
    df = spark.range(100_000).select(F.lit("k").alias("k"), (F.rand(3) * 1000).alias("x"))
    out = selection.exact_quantiles(df.withColumn("x", F.round("x", 6)), "k", "x", {"m": 0.5}, few=100)
    assert out.count() == 1 and sizes


def chosen(points, count):
    """Places of the representatives of points (id, vector), by trying all rows for each step."""
    far = lambda a, b: float(np.sqrt(((np.asarray(a) - np.asarray(b)) ** 2).sum()))
    ordered = sorted(points)
    mean = np.mean([v for _, v in ordered], axis=0)
    seeds = [min(ordered, key=lambda p: (far(p[1], mean), p[0]))]
    while len(seeds) < count:
        rest = [p for p in ordered if p[0] not in {s[0] for s in seeds}]
        seeds.append(max(rest, key=lambda p: (min(far(p[1], s[1]) for s in seeds), -p[0])))
    clusters = [[] for _ in seeds]
    for p in ordered:
        clusters[min(range(len(seeds)), key=lambda k: (far(p[1], seeds[k][1]), k))].append(p)
    out = []
    for seed, members in zip(seeds, clusters, strict=True):
        centre = np.mean([v for _, v in members], axis=0) if members else None
        out.append(min(members, key=lambda p: (far(p[1], centre), p[0]))[0] if members else seed[0])
    return out


def test_representatives_of_small_and_very_large_groups(spark):
    rng = np.random.default_rng(12)
    groups = {"large": rng.normal(size=(20_000, 3)), "small": rng.normal(size=(7, 3)), "alike": np.ones((5, 3)), "one": rng.normal(size=(1, 3))}
    rows = [(g, k, v.tolist()) for g, x in groups.items() for k, v in enumerate(x)]
    counts = {"large": 3, "small": 3, "alike": 2, "one": 1}
    df = spark.createDataFrame(rows, "group string, id long, z array<double>").repartition(5)
    got = {}
    for r in sorted(medoids.representatives(df, spark.createDataFrame(list(counts.items()), "group string, count int"), 3, 3).collect(), key=lambda r: r.place):
        got.setdefault(r.group, []).append(r.id)
    assert got == {g: chosen([(k, v.tolist()) for k, v in enumerate(x)], counts[g]) for g, x in groups.items()}


def test_words_without_validation_rows_fall_back_to_training(spark):
    rows = [(k, w, "spk", "train" if w == "b" or k % 2 else "validation", c, float(k % 50) + (0 if w == c else 100)) for w in "ab" for k in range(60) for c in "ab"]
    rows = [(r[0] + (1000 if r[1] == "b" else 0), *r[1:]) for r in rows]
    d = spark.createDataFrame(rows, "recording_id long, word string, speaker_hash string, split string, candidate string, distance double")
    used = scoring.calibrating(d).collect()
    own = {c: sorted(r.recording_id for r in used if r.own and r.candidate == c) for c in "ab"}
    assert own == {"a": list(range(0, 60, 2)), "b": list(range(1000, 1020))}
    assert {r.candidate: r.accept for r in scoring.thresholds(d, 0.05).collect()} == pytest.approx({"a": np.quantile([k % 50 for k in range(0, 60, 2)], 0.9), "b": np.quantile(range(20), 0.9)})


def test_largest_values_within_a_budget(spark):
    rng = np.random.default_rng(4)
    values = np.concatenate([np.round(rng.normal(size=3000), 2), 10.0 ** rng.integers(-9, 9, 200)])
    weights = rng.integers(0, 3, len(values))
    df = spark.createDataFrame([(float(v), int(w)) for v, w in zip(values, weights, strict=True)], "value double, weight long").cache()
    for budget in (0, 50, 1234, 10**6):
        fits = [(v, int((values >= v).sum()), int(weights[values >= v].sum())) for v in np.unique(values) if weights[values >= v].sum() <= budget]
        assert selection.largest_within(df, lambda w, most=budget: w <= most) == (min(fits) if fits else None)
    assert selection.largest_within(df.limit(0), lambda w: True) is None
    df.unpersist()
