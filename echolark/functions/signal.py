"""Numeric kernels over PCM and frame sequences: features, warping and alignment. NumPy, one recording a call."""

from __future__ import annotations

import io
import wave
from functools import lru_cache

import numpy as np

RATE, FRAME, HOP = 16_000, 400, 160


def decode_wav(data: bytes) -> bytes:
    """PCM of a mono 16-bit 16 kHz WAV; anything else is refused."""
    with wave.open(io.BytesIO(data)) as w:
        if (w.getnchannels(), w.getsampwidth(), w.getframerate(), w.getcomptype()) != (1, 2, RATE, "NONE"):
            raise ValueError("only uncompressed mono 16-bit 16 kHz audio is read")
        pcm = w.readframes(w.getnframes())
        if not pcm or len(pcm) != 2 * w.getnframes():
            raise ValueError("empty or truncated audio")
        return pcm


def samples(pcm: bytes) -> np.ndarray:
    if not pcm or len(pcm) % 2:
        raise ValueError("PCM must hold whole 16-bit samples")
    return np.frombuffer(pcm, "<i2").astype(float) / 32768


def signal_stats(pcm: bytes) -> dict[str, float]:
    x = samples(pcm)
    db = lambda v: float(20 * np.log10(max(v, 1e-12)))
    return {"duration_s": len(x) / RATE, "rms_dbfs": db(np.sqrt(np.mean(x * x))), "peak_dbfs": db(np.abs(x).max()), "clipped_ratio": float(np.mean(np.abs(x) >= 0.999))}


@lru_cache
def _filters(low: float, n: int = 26, size: int = 512) -> np.ndarray:
    """Triangles between neighbouring mel points, each point cut down to a whole FFT bin."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    points = 700 * (10 ** (np.linspace(mel(low), mel(RATE / 2), n + 2) / 2595) - 1)
    edges = np.minimum(np.floor((size + 1) * points / RATE), size // 2)
    left, peak, right = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    k = np.arange(size // 2 + 1)
    up = np.where((k >= left) & (k < peak), (k - left) / np.maximum(peak - left, 1), 0)
    down = np.where((k >= peak) & (k < right), (right - k) / np.maximum(right - peak, 1), 0)
    return up + down


@lru_cache
def _cosines(n: int = 26) -> np.ndarray:
    k = np.arange(n)
    basis = np.cos(np.pi * k[:, None] * (2 * k + 1) / (2 * n)) * np.sqrt(2 / n)
    basis[0] /= np.sqrt(2)
    return basis


def _cepstra(pcm: bytes, low: float) -> np.ndarray:
    x = samples(pcm)
    x = np.append(x[0], x[1:] - 0.97 * x[:-1])
    count = 1 + max(0, -(-(len(x) - FRAME) // HOP))
    x = np.pad(x, (0, (count - 1) * HOP + FRAME - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP] * np.hamming(FRAME)
    power = np.abs(np.fft.rfft(frames, 512)) ** 2 / 512
    return np.log(np.maximum(power @ _filters(low).T, 1e-10)) @ _cosines().T


def mfcc_summary(pcm: bytes) -> list[float]:
    """Means and population deviations of 13 coefficients; silence is refused."""
    if not samples(pcm).any():
        raise ValueError("silence")
    c = _cepstra(pcm, 0.0)[:, :13]
    return np.concatenate([c.mean(axis=0), c.std(axis=0)]).astype(np.float32).tolist()


def delta(x: np.ndarray) -> np.ndarray:
    p = np.pad(x, ((2, 2), (0, 0)), mode="edge")
    return sum(k * (p[2 + k : len(x) + 2 + k] - p[2 - k : len(x) + 2 - k]) for k in (1, 2)) / 10


def mfcc_temporal(pcm: bytes) -> np.ndarray:
    """frames x 36: twelve normalised coefficients without the first, their slopes and the slopes' slopes."""
    if np.sqrt(np.mean(samples(pcm) ** 2)) < 1e-5:
        raise ValueError("silence")
    c = _cepstra(pcm, 50.0)[:, 1:13]
    c = (c - c.mean()) / max(c.std(), 1.0)
    d = delta(c)
    return np.hstack([c, d, delta(d)]).astype(np.float32)


def dtw_distances(a: np.ndarray, b: np.ndarray, band: float = 0.3) -> np.ndarray:
    """Of each pair of a (pairs, n, d) and b (pairs, m, d), the mean cosine cost along the cheapest path
    within the band; among equal costs the shorter path. All pairs advance cell by cell together."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    pairs, n, m = len(a), a.shape[1], b.shape[1]
    norms = np.linalg.norm(a, axis=2)[:, :, None] * np.linalg.norm(b, axis=2)[:, None, :]
    plain = np.sqrt(((a[:, :, None] - b[:, None]) ** 2).sum(axis=3) / a.shape[2])
    cost = np.where(norms > 0, 1 - (a @ b.transpose(0, 2, 1)) / np.where(norms > 0, norms, 1), plain)
    width = max(abs(n - m), int(band * max(n, m)), 2)
    total, steps = np.full((n + 1, m + 1, pairs), np.inf), np.zeros((n + 1, m + 1, pairs), int)
    total[0, 0] = 0
    for i in range(1, n + 1):
        center = round(i * m / n)
        for j in range(max(1, center - width), min(m, center + width) + 1):
            ways = total[[i - 1, i, i - 1], [j, j - 1, j - 1]]
            least = ways.min(axis=0)
            lengths = np.where(ways == least, steps[[i - 1, i, i - 1], [j, j - 1, j - 1]], n + m)
            total[i, j], steps[i, j] = least + cost[:, i - 1, j - 1], lengths.min(axis=0) + 1
    if not np.isfinite(total[n, m]).all():
        raise ValueError("the band leaves no path")
    return total[n, m] / steps[n, m]


#: Rows of each side that dtw_block warps at once; binary places of a cost that it keeps at least.
TILE, PLACES = 64, 34


def _diagonals(n: int, m: int, band: float) -> list[tuple[int, int, int]]:
    """Of each sum of places i + j, the first i whose j is within the band, and the one behind the last."""
    width = max(abs(n - m), int(band * max(n, m)), 2)
    reach = [(i, i + max(1, round(i * m / n) - width), i + min(m, round(i * m / n) + width)) for i in range(1, n + 1)]
    found = []
    for s in range(2, n + m + 1):
        at = [i for i, low, high in reach if low <= s <= high]
        found.append((s, min(at, default=1), max(at, default=0) + 1))
    return found


def dtw_block(a: np.ndarray, b: np.ndarray, band: float = 0.3) -> np.ndarray:
    """dtw_distances of each of a (rows, n, d) to each of b (others, m, d), many times as fast as pair by pair.

    All pairs of a tile advance by one diagonal at once. Costs are rounded to a grid, 2^-40 for sequences of 16, and
    the steps of a path are counted in the bits below it, so that the least number is the least cost and, of equal
    ones, the shorter path. Sequences that leave too few bits are warped pair by pair."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    n, m, root = a.shape[1], b.shape[1], np.sqrt(a.shape[2])
    sizes, others = np.linalg.norm(a, axis=2)[..., None], np.linalg.norm(b, axis=2)[..., None]
    nil, void = ~(sizes > 0), ~(others > 0)
    plain = nil.any() or void.any()
    most = max(2.0, sizes.max() / root, others.max() / root) if plain else 2.0
    low = (2 * (n + m)).bit_length()
    grid = 52 - low - int(np.ceil(np.log2((n + m) * min(most, 1e300))))
    out = np.empty((len(a), len(b)))
    if grid < PLACES:
        for k in range(len(a)):
            out[k] = dtw_distances(np.broadcast_to(a[k], (len(b), *a.shape[1:])), b, band)
        return out
    step, lift = 2.0 ** -(grid + low), 1.5 * 2.0 ** (52 - grid)
    # a product of these is the cost and lift, next to which numbers have no places below the grid
    left, right = [-a / np.where(nil, 1, sizes)], [b / np.where(void, 1, others)]
    if plain:
        left += [nil, sizes / root - 1, nil]
        right += [others / root - 1, void, void]
    left = np.concatenate([*left, np.full(nil.shape, 1 + lift)], axis=2).transpose(1, 0, 2)
    right = np.concatenate([*right, np.ones(void.shape)], axis=2).transpose(1, 2, 0)[::-1]  # backwards: diagonals are runs of both
    spans, planes, costs = _diagonals(n, m, band), np.empty((3, n + 1, TILE, TILE)), np.empty((n, TILE, TILE))
    x, y = np.zeros((n, TILE, left.shape[2])), np.zeros((m, right.shape[1], TILE))
    for i in range(0, len(a), TILE):
        rows = min(TILE, len(a) - i)
        x[:, :rows] = left[:, i : i + rows]
        for j in range(0, len(b), TILE):
            columns = min(TILE, len(b) - j)
            y[:, :, :columns] = right[:, :, j : j + columns]
            planes.fill(np.inf)
            planes[0, 0] = 0
            before, last, now = planes
            for s, first, end in spans:
                cost, total = costs[: end - first], now[first:end]
                np.matmul(x[first - 1 : end - 1], y[m - s + first : m - s + end], out=cost)
                cost -= lift
                cost += step
                np.minimum(last[first - 1 : end - 1], last[first:end], out=total)
                np.minimum(total, before[first - 1 : end - 1], out=total)
                total += cost
                now[first - 1] = np.inf
                before, last, now = last, now, before
            total = last[n, :rows, :columns]
            if not np.isfinite(total).all():
                raise ValueError("the band leaves no path")
            whole = (total + lift) - lift
            out[i : i + rows, j : j + columns] = whole / ((total - whole) / step)
    return out


def dtw_distance(a: np.ndarray, b: np.ndarray, band: float = 0.3) -> float:
    return float(dtw_distances(np.asarray(a)[None], np.asarray(b)[None], band)[0])


def subsequence_distances(prototypes: np.ndarray, sequences: np.ndarray, ratios: tuple[float, ...] = (0.75, 1.0, 1.25)) -> np.ndarray:
    """Of each pair of prototypes (pairs, n, d) and sequences (pairs, m, d), the least distance of the prototype to a
    window of the sequence, of three frames at least and a hop of a fifth of the window; the last window ends with
    the sequence. All pairs advance together, a window at a time."""
    prototypes, sequences = np.asarray(prototypes, float), np.asarray(sequences, float)
    best, n = np.full(len(sequences), np.inf), sequences.shape[1]
    for ratio in ratios:
        size = min(n, max(3, round(ratio * prototypes.shape[1])))
        for k in np.append(np.arange(0, n - size, max(1, size // 5)), n - size):
            best = np.minimum(best, dtw_distances(sequences[:, k : k + size], prototypes, 1.0))
    return best


def subsequence_dtw(prototype: np.ndarray, sequence: np.ndarray, ratios: tuple[float, ...] = (0.75, 1.0, 1.25)) -> float:
    return float(subsequence_distances(np.asarray(prototype)[None], np.asarray(sequence)[None], ratios)[0])


def spread_rows(distance: np.ndarray, count: int) -> np.ndarray:
    """The most central row, then in turn the row farthest from those there."""
    at = np.zeros(min(count, len(distance)), int)
    at[0] = distance.sum(axis=1).argmin()
    gap = distance[at[0]].copy()
    for k in range(1, len(at)):
        gap[at[:k]] = -1
        at[k] = gap.argmax()
        gap = np.minimum(gap, distance[at[k]])
    return at


def medoids(distance: np.ndarray, count: int = 4, rounds: int = 8) -> list[int]:
    """Central rows of clusters around spread rows.

    With `member`, rows by clusters, each column of distance @ member holds every row's distance to the
    whole cluster; the least of its own rows is the medoid. Clusters without a row keep theirs."""
    at = spread_rows(distance, count)
    for _ in range(rounds):
        member = distance[:, at].argmin(axis=1)[:, None] == np.arange(len(at))
        cost = np.where(member, distance @ member, np.inf)
        new = np.where(member.any(axis=0), cost.argmin(axis=0), at)
        if (new == at).all():
            break
        at = new
    return at.tolist()


def ctc_path(logp: np.ndarray, labels: list[int], blank: int = 0) -> np.ndarray:
    """Place by frame on the best path through blank, label, blank, ...: label k is at place 2 k + 1.

    All places advance at once: each takes the best of staying, one step, and a step over a blank
    between two different labels, the shortest move among equals."""
    n, places = len(logp), np.full(2 * len(labels) + 1, blank)
    places[1::2] = labels
    if n < len(labels) or not labels:
        raise ValueError("too few frames or no label")
    emitted = np.asarray(logp, float)[:, places]
    over = np.zeros(len(places), bool)
    over[2:] = (places[2:] != blank) & (places[2:] != places[:-2])
    score = np.where(np.arange(len(places)) < 2, emitted[0], -np.inf)
    moves = np.zeros((n, len(places)), np.int8)
    for t in range(1, n):
        ways = np.full((3, len(places)), -np.inf)
        ways[0], ways[1, 1:] = score, score[:-1]
        ways[2, 2:] = np.where(over[2:], score[:-2], -np.inf)
        moves[t] = ways.argmax(axis=0)
        score = ways.max(axis=0) + emitted[t]
    path = np.zeros(n, int)
    path[-1] = len(places) - 1 - int(score[-2] > score[-1])
    if not np.isfinite(score[path[-1]]):
        raise ValueError("no path")
    for t in range(n - 1, 0, -1):
        path[t - 1] = path[t] - moves[t, path[t]]
    return path


def ctc_phones(logp: np.ndarray, labels: list[int], blank: int = 0, stride_ms: float = 20.0) -> list[dict]:
    """What each expected label came to on the best path, and labels that were not expected.

    A label is DELETION if its span has none or neither it nor another label reaches 0.05, SUBSTITUTION
    if another label is likelier there, else MATCH. In blank spans, runs of a label of 0.5 or more are
    INSERTION, but for labels already seen in place of another. By start, expected ones first."""
    path, p = ctc_path(logp, labels, blank), np.exp(np.asarray(logp, float))
    expected = np.asarray(labels)
    inside = path[:, None] == 2 * np.arange(len(labels)) + 1
    frames = inside.sum(axis=0)
    mean = (inside.T @ p) / np.maximum(frames, 1)[:, None]
    own = mean[np.arange(len(labels)), expected]
    mean[np.arange(len(labels)), expected] = 0
    mean[:, blank] = 0
    rival, other = mean.argmax(axis=1), mean.max(axis=1)
    sure = np.where(frames > 0, np.maximum(own, other), 0)
    seen = np.where(other > own, rival, expected)
    status = np.select([sure < 0.05, seen != expected], ["DELETION", "SUBSTITUTION"], "MATCH")
    first, last = inside.argmax(axis=0), len(path) - inside[::-1].argmax(axis=0)
    ms = lambda k: int(np.rint(k * stride_ms))
    out = []
    for k, label in enumerate(labels):
        span = (last[k] - first[k]) * stride_ms
        there = frames[k] > 0
        out.append(dict(expected=label, observed=int(seen[k]) if there else None, start_ms=ms(first[k]) if there else 0, end_ms=ms(last[k]) if there else 0, p_expected=float(own[k]) if there else 0.0, p_other=float(other[k]) if there else 0.0, confidence=float(sure[k]), status=str(status[k]), odd_duration=bool(there and not 20 <= span <= 500)))
    p[:, blank] = 0
    loud, top = p.argmax(axis=1), p.max(axis=1)
    extra = (path % 2 == 0) & (top >= 0.5) & ~np.isin(loud, seen[status == "SUBSTITUTION"])
    at = np.flatnonzero(extra)
    cut = np.flatnonzero((np.diff(at) > 1) | (np.diff(loud[at]) != 0)) + 1
    for run in np.split(at, cut) if len(at) else []:
        level = float(top[run].mean())
        out.append(dict(expected=None, observed=int(loud[run[0]]), start_ms=ms(run[0]), end_ms=ms(run[-1] + 1), p_expected=0.0, p_other=level, confidence=level, status="INSERTION", odd_duration=False))
    return sorted(out, key=lambda x: (x["start_ms"], x["expected"] is None))
