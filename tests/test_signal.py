import io
import wave

import numpy as np
import pytest

from echolark.functions import signal as s


def tone(hz, seconds=0.5, amplitude=10_000):
    return (amplitude * np.sin(2 * np.pi * hz * np.arange(int(16_000 * seconds)) / 16_000)).astype("<i2").tobytes()


def test_warping_is_symmetric_and_nil_on_itself():
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=(20, 6)), rng.normal(size=(24, 6))
    assert s.dtw_distance(a, a) == pytest.approx(0, abs=1e-12)
    assert s.dtw_distance(a, b, 1.0) == pytest.approx(s.dtw_distance(b, a, 1.0))
    assert s.dtw_distance(a, b) > 0


def test_planted_subsequence_is_found():
    rng = np.random.default_rng(7)
    prototype, noise = rng.normal(size=(12, 36)), rng.normal(size=(50, 36))
    noise[20:32] = prototype
    assert s.subsequence_dtw(prototype, noise) == pytest.approx(0, abs=1e-9)


def test_features_have_their_shapes_and_refuse_silence():
    assert len(s.mfcc_summary(tone(330))) == 26
    assert s.mfcc_temporal(tone(330)).shape[1] == 36
    for f in (s.mfcc_summary, s.mfcc_temporal):
        with pytest.raises(ValueError):
            f(bytes(3200))


def test_ctc_path_follows_the_winners():
    winners = [0, 1, 1, 0, 2, 2, 0]
    logp = np.log(np.where(np.eye(3)[winners] > 0, 0.9, 0.05))
    assert [[0, 1, 0, 2, 0][k] for k in s.ctc_path(logp, [1, 2])] == winners
    with pytest.raises(ValueError):
        s.ctc_path(logp[:1], [1, 2])


def test_wav_must_be_mono_16_bit_16_khz():
    def wav(rate):
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
            w.writeframes(tone(220))
        return out.getvalue()

    assert s.decode_wav(wav(16_000)) == tone(220)
    with pytest.raises(ValueError):
        s.decode_wav(wav(8_000))


def test_medoids_are_rows():
    d = np.abs(np.subtract.outer(np.arange(9.0), np.arange(9.0)))
    assert len(set(s.medoids(d, 3))) == 3


def every_path(logp, labels, blank=0):
    """The best score of all paths that the labels allow, tried one by one."""
    states = [blank]
    for x in labels:
        states += [x, blank]
    best = -np.inf
    stack = [(0, k, logp[0, states[k]]) for k in range(min(2, len(states)))]
    while stack:
        t, k, score = stack.pop()
        if t == len(logp) - 1:
            best = max(best, score) if k >= len(states) - 2 else best
            continue
        for step in (0, 1, 2):
            to = k + step
            if to < len(states) and (step < 2 or (states[to] != blank and states[to] != states[k])):
                stack.append((t + 1, to, score + logp[t + 1, states[to]]))
    return best


def test_ctc_path_is_the_best_of_all_paths():
    rng = np.random.default_rng(3)
    for labels in ([1], [1, 2], [1, 1], [2, 1, 2], [3, 3, 1]):
        for n in (len(labels) + labels.count(1), 6, 7):
            logp = np.log(rng.dirichlet(np.ones(4), n))
            places = np.zeros(2 * len(labels) + 1, int)
            places[1::2] = labels
            path = s.ctc_path(logp, labels)
            assert logp[np.arange(n), places[path]].sum() == pytest.approx(every_path(logp, labels))
            assert (np.diff(path) >= 0).all() and path[0] < 2 and path[-1] >= 2 * len(labels) - 1


def test_ctc_phones_tell_what_happened():
    def evidence(winners, n=5):
        return np.log(np.where(np.eye(n)[winners] > 0, 0.92, 0.02))

    found = s.ctc_phones(evidence([0, 1, 1, 0, 2, 2, 0, 3, 0]), [1, 2, 3])
    assert [(x["expected"], x["observed"], x["status"], x["start_ms"], x["end_ms"]) for x in found] == [(1, 1, "MATCH", 20, 60), (2, 2, "MATCH", 80, 120), (3, 3, "MATCH", 140, 160)]
    swapped = s.ctc_phones(evidence([0, 1, 1, 0, 4, 4, 0, 3, 0]), [1, 2, 3])
    assert [(x["observed"], x["status"]) for x in swapped] == [(1, "MATCH"), (4, "SUBSTITUTION"), (3, "MATCH")]
    more = s.ctc_phones(evidence([0, 1, 1, 0, 4, 0, 3, 3, 0]), [1, 3])
    assert [(x["expected"], x["observed"], x["status"]) for x in more] == [(1, 1, "MATCH"), (None, 4, "INSERTION"), (3, 3, "MATCH")]


def test_mel_filters_stand_on_whole_bins():
    f = s._filters(0.0)
    mel = np.linspace(0, 2595 * np.log10(1 + 8000 / 700), 28)
    bins = [int(513 * (700 * (10 ** (m / 2595) - 1)) / 16_000) for m in mel]
    for i in (0, 5, 12, 25):
        a, b, c = bins[i : i + 3]
        row = [(k - a) / (b - a) if a <= k < b else (c - k) / (c - b) if b <= k < c else 0.0 for k in range(257)]
        assert f[i] == pytest.approx(row)


def test_medoids_are_central():
    x = np.concatenate([np.linspace(0, 1, 7), np.linspace(10, 11, 5), [30.0]])
    d = np.abs(np.subtract.outer(x, x))
    assert sorted(s.medoids(d, 3)) == [3, 9, 12]
    assert s.medoids(d[:1, :1]) == [0]


def warped(a, b, band):
    """The recurrence written out: (cost, steps) of the best path to each cell."""
    n, m = len(a), len(b)
    cost = [[1 - x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) for y in b] for x in a]
    width = max(abs(n - m), int(band * max(n, m)), 2)
    at = {(0, 0): (0.0, 0)}
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            ways = [at[k] for k in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if k in at]
            if ways and abs(j - round(i * m / n)) <= width:
                total, steps = min(ways)
                at[i, j] = (total + cost[i - 1][j - 1], steps + 1)
    return at[n, m][0] / at[n, m][1]


def test_many_pairs_at_once_are_warped_as_one_by_one():
    rng = np.random.default_rng(2)
    for n, m in ((5, 5), (9, 14), (16, 7)):
        a, b = rng.normal(size=(6, n, 3)), rng.normal(size=(6, m, 3))
        assert s.dtw_distances(a, b, 0.3) == pytest.approx([warped(x, y, 0.3) for x, y in zip(a, b)])
