"""Medoids are chosen among all rows of a word, whatever its size."""

import numpy as np
import pandas as pd
import pytest

from echolark.functions import signal
from echolark.operators import kernels, warped_medoids

SCHEMA = "word string, recording_id long, embedding array<float>"


def by_whole_matrix(rows):
    """(word, place, id) by all distances of a word, pair by pair."""
    found = []
    for word in {w for w, _, _ in rows}:
        own = sorted((i, x) for w, i, x in rows if w == word)
        left, right = np.triu_indices(len(own), 1)
        d = np.zeros((len(own), len(own)))
        if len(left):
            values = pd.Series([np.float32(x) for _, x in own])
            d[left, right] = d[right, left] = kernels._warped(values[left], values[right])
        found += [(word, k, own[at][0]) for k, at in enumerate(signal.medoids(d.round(9)))]
    return sorted(found, key=str)


def told(df):
    return sorted(((r.word, r.proto_idx, r.recording_id) for r in df.collect()), key=str)


def clusters(rng, n):
    """Values of n recordings around five patterns; far more of them than one in 36 of evenly spaced ids."""
    patterns = rng.normal(size=(5, 64))
    return [(patterns[k % 5] + rng.normal(size=64) * 0.3).tolist() for k in range(n)]


def test_every_training_row_may_become_a_medoid(spark, sf_dir):
    rows = [tuple(r) for r in kernels.temporal(spark, sf_dir).where("split = 'train'").select("word", "recording_id", "embedding").collect()]
    assert told(kernels.medoid_prototypes(spark, sf_dir)) == by_whole_matrix(rows)


def test_all_test_recordings_meet_medoids_of_all_rows(spark, sf_dir):
    t = kernels.temporal(spark, sf_dir).select("word", "recording_id", "embedding", "split").collect()
    at = {r.recording_id: np.array(r.embedding).reshape(-1, 4) for r in t}
    chosen = by_whole_matrix([(r.word, r.recording_id, r.embedding) for r in t if r.split == "train"])
    want = {r.recording_id: min(signal.subsequence_dtw(at[i][4:12], at[r.recording_id]) for w, _, i in chosen if w == r.word) for r in t if r.split == "test"}
    found = {r.recording_id: r.distance for r in kernels.subsequence_nearest(spark, sf_dir).collect()}
    assert found.keys() == want.keys() and found == pytest.approx(want, abs=1e-6)


def test_large_words_have_the_medoids_of_their_whole_matrix(monkeypatch, spark):
    rng = np.random.default_rng(7)
    rows = [("a", 1_000 + 7 * k, x) for k, x in enumerate(clusters(rng, 70))]
    rows += [("b", 10 + k, x) for k, x in enumerate(clusters(rng, 3))]
    rows += [(None, 500 + k, x) for k, x in enumerate(clusters(rng, 40))]
    rows += [("c", 2_000 + k, x[: 64 - 4 * (k % 3)]) for k, x in enumerate(clusters(rng, 31))]
    rows += [("d", 3_000 + k, [0.0] * 8 + clusters(rng, 1)[0][: 4 * (k % 4)] + [0.5] * 8) for k in range(30)]
    want = by_whole_matrix(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    assert told(warped_medoids.warped_medoids(df)) == want
    calls, large = [], warped_medoids.of_large
    monkeypatch.setattr(warped_medoids, "of_large", lambda x: calls.append(1) or large(x))
    for name, value in {"WHOLE": 25, "BLOCK": 8, "LARGE_BLOCK": 40, "SMALL": 2}.items():
        monkeypatch.setattr(warped_medoids, name, value)
    assert told(warped_medoids.warped_medoids(df)) == want and calls


def test_copies_are_rows_too(monkeypatch, spark):
    rng = np.random.default_rng(8)
    kinds = clusters(rng, 2)
    rows = [("a", 90 - k, kinds[k % 2]) for k in range(40)]
    want = by_whole_matrix(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    assert told(warped_medoids.warped_medoids(df)) == want
    monkeypatch.setattr(warped_medoids, "WHOLE", 25)
    monkeypatch.setattr(warped_medoids, "BLOCK", 8)
    assert told(warped_medoids.warped_medoids(df)) == want


def test_blocks_are_warped_as_pairs_are():
    rng = np.random.default_rng(9)
    for n, m, p, q, scale in ((16, 16, 70, 130, 1), (5, 9, 3, 4, 1), (9, 5, 66, 65, 20), (1, 6, 2, 3, 1), (40, 50, 3, 4, 1), (4, 4, 3, 3, 1e6)):
        for zeros in (False, True):
            a, b = scale * rng.normal(size=(p, n, 4)), scale * rng.normal(size=(q, m, 4))
            b[1, 0] = a[1, 0]
            if zeros:
                a[0, :2], b[0], b[-1, 1:] = 0, 0, 0
            for band in (0.3, 1.0):
                want = signal.dtw_distances(np.repeat(a, q, axis=0), np.tile(b, (p, 1, 1)), band).reshape(p, q)
                assert signal.dtw_block(a, b, band) == pytest.approx(want, abs=1e-11, rel=1e-11)
    a = rng.normal(size=(130, 16, 4))
    d = signal.dtw_block(a, a)
    assert (d == d.T).all() and not np.diag(d).any()
    assert all((signal.dtw_block(a[k : k + 3], a[k:]) == d[k : k + 3, k:]).all() for k in range(0, 130, 9))


def test_values_that_are_not_finite_are_refused():
    a = np.ones((3, 4, 4))
    for bad in (np.nan, np.inf):
        a[1, 2, 0] = bad
        with pytest.raises(ValueError), np.errstate(invalid="ignore"):
            signal.dtw_block(a, a)
