"""Alignment of frames to a reference as they come, in NumPy."""

from __future__ import annotations

import numpy as np


def cosine_costs(frame: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """1 - cosine of the frame and each reference row; norms count as 1e-8 at least."""
    norms = np.linalg.norm(reference, axis=1) * np.linalg.norm(frame)
    return 1 - np.clip(reference @ frame / np.maximum(norms, 1e-8), -1, 1)


class OnlineAligner:
    """One row of warping costs: a path stays on its reference row or goes on by one.

    `costs` and `lengths` have a place before the first row, which only the first frame starts from;
    given back, they go on where another aligner left off."""

    def __init__(self, reference: np.ndarray, costs: list[float] | None = None, lengths: list[int] | None = None):
        self.reference = np.asarray(reference, float)
        n = len(self.reference) + 1
        self.costs = np.where(np.arange(n) > 0, np.inf, 0.0) if costs is None else np.array(costs, float)
        self.lengths = np.zeros(n, int) if lengths is None else np.array(lengths, int)

    def push(self, frame: np.ndarray) -> tuple[int, float]:
        """The reference row of the best path after the frame, by cost a step, and the frame's cost there.
        Of equal costs the shorter path goes on."""
        local = cosine_costs(np.asarray(frame, float), self.reference)
        stay, step = self.costs[1:], self.costs[:-1]
        advance = (step < stay) | ((step == stay) & (self.lengths[:-1] < self.lengths[1:]))
        cost = np.where(advance, step, stay) + local
        length = np.where(advance, self.lengths[:-1], self.lengths[1:]) + np.isfinite(cost)
        at = int(np.argmin(cost / np.maximum(length, 1)))
        if not np.isfinite(cost[at]):
            raise ValueError("no path is left")
        self.costs, self.lengths = np.append(np.inf, cost), np.append(0, np.where(np.isfinite(cost), length, 0))
        return at, float(local[at])

    def final_distance(self) -> float:
        """Cost a step of the path that has reached the reference's end; infinite if none has."""
        return float(self.costs[-1] / self.lengths[-1]) if self.lengths[-1] and np.isfinite(self.costs[-1]) else float("inf")
