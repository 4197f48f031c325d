"""Vectorised words, lines and hashes over whole Arrow batches of text.

Everything here works on the UTF-8 bytes of many documents at once. A word is a maximal run of
bytes other than \\x20 and \\x09-\\x0D, lines end at \\n, and neither crosses a document's end.
Null texts count as empty. Memory is bounded by `SLICE_BYTES` or by the longest single document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 512 << 10

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the rolling multiplier, grown on demand."""
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 2 * len(_powers), 4096), _MULTIPLIER, np.uint64)
        grown[0] = 1
        _powers = np.cumprod(grown, dtype=np.uint64)
    return _powers[:n]


@dataclass
class Texts:
    """Bytes of a run of documents: document i is data[offsets[i]:offsets[i + 1]]."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def texts_of(column: pa.Array) -> Iterator[Texts]:
    """Slices of an Arrow string column, each of SLICE_BYTES at most or of one document."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, where, what = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(what, np.uint8) if what is not None and what.size else np.zeros(0, np.uint8)
    start = 0
    while start < len(offsets) - 1:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + SLICE_BYTES, "right")) - 1)
        yield Texts(data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start])
        start = stop


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte run data[starts[i]:ends[i]]; runs are disjoint, ordered and not empty."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    before = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum())) - np.repeat(before, lengths)
    codes = BYTE_CODES[data[at + np.repeat(starts, lengths)]]
    codes *= powers(int(lengths.max()))[at]
    return mix(np.add.reduceat(codes, before) ^ (lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


@dataclass
class Runs:
    """Words or lines of a Texts: byte bounds, document of each, and first run of each document."""

    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)


def words_of(t: Texts) -> Runs:
    word = ~SPACE[t.data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    inner = t.offsets[(t.offsets > 0) & (t.offsets < len(t.data))]
    begins[inner] = word[inner]
    closes = word.copy()
    closes[:-1] &= ~word[1:]
    closes[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    return _placed(t, starts, ends)


def lines_of(t: Texts) -> Runs:
    """Every \\n-split line that holds a word."""
    cuts = np.flatnonzero(t.data == 0x0A)
    starts = np.unique(np.concatenate([t.offsets[:-1], cuts + 1]))
    starts = starts[starts < len(t.data)]
    bounds = np.append(starts, len(t.data))[1:]
    ends = bounds - (t.data[bounds - 1] == 0x0A) if len(starts) else bounds
    seen = np.concatenate([[0], np.cumsum(~SPACE[t.data])])
    full = seen[ends] > seen[starts]
    return _placed(t, starts[full], ends[full])


def _placed(t: Texts, starts: np.ndarray, ends: np.ndarray) -> Runs:
    first = np.searchsorted(starts, t.offsets)
    return Runs(starts, ends, np.repeat(np.arange(len(t)), np.diff(first)), first)


def windows(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First run and hash of every n consecutive runs of one document."""
    if len(hashes) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(doc[n - 1 :] == doc[: len(doc) - n + 1])
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out = mix(out + hashes[at + k] + np.uint64(k + 1))
    return at, out


def per_doc(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Sum of values by document as int64."""
    return np.bincount(doc, values, n).astype(np.int64)


def span_counts(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of flags are set between each two offsets."""
    seen = np.concatenate([[0], np.cumsum(flags)])
    return seen[offsets[1:]] - seen[offsets[:-1]]
