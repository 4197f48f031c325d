"""Suffix arrays by two-stage sorting, in whole-array NumPy steps.

A suffix is type B if it is smaller than the suffix that starts one byte later, else type A. Only
type B suffixes are sorted directly, eight bytes a round and only where ties are left, to `depth`
bytes. One scan over the first-byte buckets from the smallest then induces all type A suffixes: the
predecessor of each suffix met, if of type A, takes the next free place at the front of its bucket.
A bucket is scanned in waves, as suffixes that land in the bucket being scanned form the next wave.
Suffixes that agree in `depth` bytes come in any order.
"""

from __future__ import annotations

import numpy as np


def words8(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, big-endian, as one number; zero bytes beyond the end."""
    out = data.astype(np.uint64)
    for k in (1, 2, 4):
        shifted = np.zeros_like(out)
        shifted[:-k] = out[k:]
        out = (out << np.uint64(8 * k)) | shifted
    return out


def _sorted_directly(at: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Places ordered by their next `depth` bytes."""
    n = len(words)
    order = np.argsort(words[at], kind="stable")
    at = at[order]
    first = words[at]
    group = np.zeros(len(at), np.int64)
    group[1:] = np.cumsum(first[1:] != first[:-1])
    for offset in range(8, depth, 8):
        counts = np.bincount(group)
        tied = np.flatnonzero(counts[group] > 1)
        if not len(tied):
            break
        ahead = at[tied] + offset
        key = np.where(ahead < n, words[np.minimum(ahead, n - 1)], np.uint64(0))
        order = np.lexsort((key, group[tied]))
        at[tied] = at[tied][order]
        key, own = key[order], group[tied]
        new = np.zeros(len(group), np.int64)
        new[1:] = group[1:] != group[:-1]
        split = np.zeros(len(tied), bool)
        split[1:] = (own[1:] == own[:-1]) & (key[1:] != key[:-1])
        new[tied[split]] = 1
        group = np.cumsum(new)
    return at


def suffix_array(data: np.ndarray, depth: int, words: np.ndarray | None = None) -> np.ndarray:
    """Starts of all suffixes of data, ordered by their first `depth` bytes at least."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    words = words8(data) if words is None else words
    # type B: the first differing byte to the right is larger; the last suffix is type A
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(data[1:].astype(np.int16) - data[:-1].astype(np.int16))
    step[-1] = -1
    known = np.flatnonzero(step)
    is_b = step[known[np.searchsorted(known, np.arange(n))]] > 0
    counts = np.bincount(data, minlength=256)
    ends = np.cumsum(counts)
    front = ends - counts
    out = np.full(n, -1, np.int64)
    b = _sorted_directly(np.flatnonzero(is_b), words, depth)
    b_counts = np.bincount(data[b], minlength=256)
    b_from = ends - b_counts
    out[np.repeat(b_from - (np.cumsum(b_counts) - b_counts), b_counts) + np.arange(len(b))] = b

    def place(found: np.ndarray) -> None:
        before = found[found > 0] - 1
        before = before[~is_b[before]]
        if len(before):
            to = data[before]
            order = np.argsort(to, kind="stable")
            before, to = before[order], to[order]
            new = np.flatnonzero(np.diff(to, prepend=to[0] + 1 if to[0] < 255 else 0))
            sizes = np.diff(np.append(new, len(to)))
            heads = to[new]
            out[np.repeat(front[heads] - new, sizes) + np.arange(len(to))] = before
            front[heads] += sizes

    place(np.array([n], np.int64))
    for byte in np.flatnonzero(counts).tolist():
        done = int(ends[byte] - counts[byte])
        while done < front[byte]:
            upto = int(front[byte])
            place(out[done:upto])
            done = upto
        place(out[b_from[byte] : ends[byte]])
    return out


def common_prefixes(order: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the array, up to depth, in bytes."""
    n, out = len(words), np.zeros(len(order), np.int64)
    open_ = np.arange(1, len(order))
    for offset in range(0, depth, 8):
        if not len(open_):
            break
        a, b = order[open_ - 1] + offset, order[open_] + offset
        inside = np.minimum(n - a, n - b)
        differ = words[np.minimum(a, n - 1)] ^ words[np.minimum(b, n - 1)]
        zeros = np.full(len(open_), 8)
        for k in range(7, -1, -1):
            zeros[(differ >> np.uint64(56 - 8 * k)) & np.uint64(0xFF) != 0] = k
        out[open_] = offset + np.minimum(zeros, np.maximum(inside, 0))
        open_ = open_[(zeros == 8) & (inside >= 8)]
    return np.minimum(out, depth)
