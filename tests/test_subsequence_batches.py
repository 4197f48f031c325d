"""Prototypes are sought in many recordings at once, with the distances of one at a time."""

import numpy as np
import pandas as pd

from echolark.functions import signal
from echolark.operators import kernels


def one_window_at_a_time(prototype, sequence):
    best, n = np.inf, len(sequence)
    for ratio in (0.75, 1.0, 1.25):
        size = min(n, max(3, round(ratio * len(prototype))))
        for k in [*range(0, n - size, max(1, size // 5)), n - size]:
            best = min(best, signal.dtw_distance(sequence[k : k + size], prototype, 1.0))
    return best


def test_pairs_of_one_shape_are_warped_together(monkeypatch):
    rng = np.random.default_rng(5)
    shapes = [(8, 16), (5, 7), (8, 2)] * 20
    a, b = [rng.normal(size=(n, 4)) for n, _ in shapes], [rng.normal(size=(m, 4)) for _, m in shapes]
    a[3][:], b[6][:], b[7][1:] = 1, 0, 0
    want = [one_window_at_a_time(x, y) for x, y in zip(a, b, strict=True)]
    calls, whole = [], signal.dtw_distances
    monkeypatch.setattr(signal, "dtw_distances", lambda *x: calls.append(len(x[0])) or whole(*x))
    found = kernels._sought(pd.Series([x.ravel() for x in a]), pd.Series([y.ravel() for y in b]))
    assert found.tolist() == want
    assert set(calls) == {20}  # a shape's windows, not a pair's
