"""Warping of prototypes to a stream of frames and of labels to a stream of evidence, one frame at a time."""

from __future__ import annotations

import numpy as np


def frame_costs(frames: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine cost of each frame and each row; plain distance where one of them is nil."""
    sizes = np.linalg.norm(frames, axis=-1)[:, None] * np.linalg.norm(rows, axis=-1)
    plain = np.linalg.norm(frames[:, None] - rows, axis=-1) / np.sqrt(rows.shape[-1])
    return np.where(sizes > 0, 1 - frames @ rows.T / np.where(sizes > 0, sizes, 1), plain)


def ending_distances(prototype: np.ndarray, frames: np.ndarray) -> np.ndarray:
    """For every frame, the mean cost along the cheapest path through the whole prototype that ends at it and
    begins anywhere before; among equal costs the shorter path. The whole table at once, as reference for the stream."""
    cost = frame_costs(np.asarray(frames, float), np.asarray(prototype, float))
    n, m = cost.shape
    total, steps = np.full((n, m), np.inf), np.zeros((n, m), int)
    for i in range(n):
        total[i, 0], steps[i, 0] = cost[i, 0], 1
        for j in range(1, m):
            ways = [(total[i, j - 1], steps[i, j - 1])]
            if i:
                ways += [(total[i - 1, j], steps[i - 1, j]), (total[i - 1, j - 1], steps[i - 1, j - 1])]
            least, length = min(ways)
            total[i, j], steps[i, j] = least + cost[i, j], length + 1
    return total[:, -1] / steps[:, -1]


class StreamWarp:
    """Prototypes of one shape, all warped to a stream: a column of costs and path lengths for each is the
    state, as long as a prototype and no longer, however many frames have come."""

    def __init__(self, prototypes: np.ndarray, costs: list[float] | None = None, lengths: list[int] | None = None):
        self.prototypes = np.asarray(prototypes, float)
        shape = self.prototypes.shape[:2]
        self.costs = np.full(shape, np.inf) if costs is None else np.array(costs, float).reshape(shape)
        self.lengths = np.zeros(shape, int) if lengths is None else np.array(lengths, int).reshape(shape)

    def push(self, frame: np.ndarray) -> np.ndarray:
        """The distance of each prototype to what ends with the frame."""
        kinds, rows, dims = self.prototypes.shape
        local = frame_costs(np.asarray(frame, float)[None], self.prototypes.reshape(-1, dims)).reshape(kinds, rows)
        costs, lengths = np.empty_like(local), np.ones((kinds, rows), int)
        costs[:, 0] = local[:, 0]
        for j in range(1, rows):
            ways = np.stack([costs[:, j - 1], self.costs[:, j], self.costs[:, j - 1]])
            taken = np.stack([lengths[:, j - 1], self.lengths[:, j], self.lengths[:, j - 1]])
            least = ways.min(axis=0)
            costs[:, j] = least + local[:, j]
            lengths[:, j] = np.where(ways == least, taken, np.iinfo(int).max).min(axis=0) + 1
        self.costs, self.lengths = costs, lengths
        return costs[:, -1] / lengths[:, -1]


class StreamLabels:
    """Viterbi over blank, label, blank, ... of expected labels as evidence comes.

    Places whose score is more than `beam` below the best are given up. Kept are a score for each place and
    the moves since the last frame at which all places that are left came from one place; up to there the
    path can change no more, and is given out. With an infinite beam the whole path, given out at the end,
    is that of Viterbi over all evidence."""

    def __init__(self, labels: list[int], blank: int = 0, beam: float = np.inf, scores: list[float] | None = None, moves: list[int] | None = None):
        self.beam = beam
        self.places = np.full(2 * len(labels) + 1, blank)
        self.places[1::2] = labels
        self.over = np.zeros(len(self.places), bool)
        self.over[2:] = (self.places[2:] != blank) & (self.places[2:] != self.places[:-2])
        n = len(self.places)
        self.scores = None if scores is None else np.array(scores, float)
        self.moves = list(np.array([] if moves is None else moves, int).reshape(-1, n))
        # ways to each place: staying, one step, a step over a place; barred are those that never can be taken
        self.ways, self.barred = np.full((3, n), -np.inf), np.where(self.over[2:], 0.0, -np.inf)
        self.all = self.roots = np.arange(n)
        for move in self.moves[:0:-1]:
            self.roots = self.roots - move[self.roots]

    def push(self, evidence: np.ndarray) -> list[int]:
        """Places of the frames that are certain from now on."""
        emitted, n = np.asarray(evidence, float)[self.places], len(self.places)
        if self.scores is None:
            self.scores, move = np.where(self.all < 2, emitted, -np.inf), np.zeros(n, int)
        else:
            ways = self.ways
            ways[0], ways[1, 1:] = self.scores, self.scores[:-1]
            np.add(self.scores[:-2], self.barred, out=ways[2, 2:])
            move = ways.argmax(axis=0)
            self.scores = ways.max(axis=0) + emitted
        self.roots = self.roots[self.all - move] if self.moves else self.all
        self.moves.append(move)
        self.scores[self.scores < self.scores.max() - self.beam] = -np.inf
        return self._given_out(np.flatnonzero(np.isfinite(self.scores)))

    def _given_out(self, ends: np.ndarray) -> list[int]:
        """Where the live places are one at the oldest frame kept, follows them back to the last frame at which they
        are, and gives out the path up to there. `roots` has the place of each at the oldest frame, so that frames
        at which nothing is settled are not followed back."""
        if not len(ends) or (self.roots[ends] != self.roots[ends[0]]).any():
            return []
        at, roots = ends, self.all
        for k in range(len(self.moves) - 1, -1, -1):
            if (at == at[0]).all():
                path, place = [int(at[0])], int(at[0])
                for moves in self.moves[k:0:-1]:
                    place -= int(moves[place])
                    path.append(place)
                self.moves, self.roots = self.moves[k + 1 :], roots
                return path[::-1]
            roots = self.all.copy()
            roots[ends] = at
            at = at - self.moves[k][at]
        return []

    def finish(self) -> list[int]:
        """The rest of the best path: it ends at the last label or the blank behind it."""
        if self.scores is None or not np.isfinite(self.scores[-2:]).any():
            return []
        last = len(self.places) - 1 - int(self.scores[-2] > self.scores[-1])
        if not self.moves:
            return []
        return self._given_out(np.array([last]))

    def kept(self) -> list[int]:
        return np.concatenate(self.moves).tolist() if self.moves else []
