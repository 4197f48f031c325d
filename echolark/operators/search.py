"""Search for joint thresholds: a Gaussian process proposes, one aggregate a round judges.

What is to be minimised is a share of rows, and rows are many; so each round proposes several thresholds,
and all of them are judged by one pass over the rows. The driver holds the thresholds judged so far and
their values, nothing of the rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import erf, pi

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echolark.core import read_table, staged

ROUNDS, EACH_ROUND, POOL, NOISE, SMOOTH = 10, 8, 1024, 1e-6, 0.2
UNDECIDED_COST = 0.3


@dataclass(frozen=True)
class Found:
    point: tuple[float, ...]
    value: float
    judged: int


def normal_pdf(z: np.ndarray) -> np.ndarray:
    return np.exp(-z * z / 2) / np.sqrt(2 * pi)


def normal_cdf(z: np.ndarray) -> np.ndarray:
    return np.array([0.5 * (1 + erf(x / np.sqrt(2))) for x in np.ravel(z)]).reshape(np.shape(z))


class Process:
    """A Gaussian process over the unit cube, of values in units of their own mean and spread."""

    def __init__(self, points: np.ndarray, values: np.ndarray):
        self.points = points
        self.mean, self.spread = values.mean(), values.std() or 1.0
        self.root = np.linalg.cholesky(self._near(points, points) + NOISE * np.eye(len(points)))
        self.weights = self._solved((values - self.mean) / self.spread)

    @staticmethod
    def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.exp(-((a[:, None] - b) ** 2).sum(axis=2) / (2 * SMOOTH * SMOOTH))

    def _solved(self, y: np.ndarray) -> np.ndarray:
        return np.linalg.solve(self.root.T, np.linalg.solve(self.root, y))

    def predicted(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and deviation of the value at each point."""
        k = self._near(points, self.points)
        part = np.linalg.solve(self.root, k.T)
        return self.mean + self.spread * (k @ self.weights), self.spread * np.sqrt(np.clip(1 - (part * part).sum(axis=0), 1e-12, None))


def expected_gain(mean: np.ndarray, deviation: np.ndarray, best: float) -> np.ndarray:
    """How much lower than `best` a value of this mean and deviation is expected to be, counting gains only."""
    z = (best - mean) / deviation
    return deviation * (z * normal_cdf(z) + normal_pdf(z))


def proposed(points: np.ndarray, values: np.ndarray, rng: np.random.Generator, count: int) -> np.ndarray:
    """`count` points of the largest expected gain, one after the other, each taken for what the process expects of
    it. Half of the pool is drawn around the best point, half from everywhere."""
    pool = rng.uniform(size=(POOL, points.shape[1]))
    pool[::2] = np.clip(points[values.argmin()] + rng.normal(scale=0.05, size=pool[::2].shape), 0, 1)
    points, values = points.copy(), values.copy()
    for _ in range(count):
        mean, deviation = Process(points, values).predicted(pool)
        at = int(expected_gain(mean, deviation, values.min()).argmax())
        points, values = np.vstack([points, pool[at]]), np.append(values, mean[at])
    return points[-count:]


def minimised(judge: Callable[[np.ndarray], np.ndarray], bounds: list[tuple[float, float]], rounds: int = ROUNDS, each: int = EACH_ROUND, seed: int = 0) -> Found:
    """The best of the points that `judge` was asked for, first ones among equals. It gets `each` points a round and gives
    their values, which must be finite; a seed always gives the same search."""
    low, high = np.array(bounds, float).T
    if not (len(bounds) and (low < high).all() and np.isfinite([low, high]).all()):
        raise ValueError("every bound must be finite and in order")
    if rounds < 1 or each < 2:
        raise ValueError("a search needs a round, and two points each")
    rng = np.random.default_rng(seed)
    points, values = np.zeros((0, len(bounds))), np.zeros(0)
    for k in range(rounds):
        new = proposed(points, values, rng, each) if k else rng.uniform(size=(each, len(bounds)))
        got = np.asarray(judge(low + new * (high - low)), float)
        if got.shape != (each,) or not np.isfinite(got).all():
            raise ValueError("values must be finite, one a point")
        points, values = np.vstack([points, new]), np.append(values, got)
    best = int(values.argmin())
    return Found(tuple((low + points[best] * (high - low)).tolist()), float(values[best]), len(values))


def decision_cost(rows: DataFrame, points: np.ndarray, rule: Callable[[np.ndarray], tuple[Column, Column]]) -> np.ndarray:
    """Of each point the share of bad rows accepted, of good rows rejected and, at UNDECIDED_COST, of rows left
    undecided: one aggregate for all points. rule(point) gives when a row is accepted and when rejected."""
    good = F.col("good")
    n = [F.count_if(good).alias("good"), F.count_if(~good).alias("bad")]
    for k, point in enumerate(points):
        accepted, rejected = rule(point)
        n += [F.count_if(accepted & ~good).alias(f"a{k}"), F.count_if(rejected & good).alias(f"r{k}"), F.count_if(~accepted & ~rejected).alias(f"u{k}")]
    r = rows.agg(*n).first()
    share = lambda x, of: x / of if of else 0.0
    return np.array([share(r[f"a{k}"], r.bad) + share(r[f"r{k}"], r.good) + UNDECIDED_COST * share(r[f"u{k}"], r.good + r.bad) for k in range(len(points))])


def two_limits(point: np.ndarray) -> tuple[Column, Column]:
    """Accepted: both scores at their limits or above; rejected: one lies more than a margin below its limit."""
    first, second, margin = (float(x) for x in point)
    accepted = (F.col("x") >= first) & (F.col("y") >= second)
    return accepted, ~accepted & ((F.col("x") < first - margin) | (F.col("y") < second - margin))


def threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits for the length and the variety of labelled documents, with the cost of the best limits found and how many were judged."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.log10(F.col("n_chars") + 1).alias("x"), (F.size(F.array_distinct(F.split("text", " "))) / F.size(F.split("text", " "))).alias("y"))
    rows = docs.join(read_table(spark, sf_dir, "labels").where("quality is not null").select("doc_id", (F.col("quality") == 1).alias("good")), "doc_id")
    rows = staged(rows.select("x", "y", "good").where("x is not null and y is not null"))
    found = minimised(lambda points: decision_cost(rows, points, two_limits), [(0.5, 5.0), (0.0, 1.0), (0.0, 0.5)])
    out = [(*(round(x, 6) for x in found.point), round(found.value, 6), found.judged)]
    return spark.createDataFrame(out, "least_length double, least_variety double, margin double, cost double, judged long")


QUERIES = {"threshold_search": threshold_search}
ORACLE_SQL: dict[str, str] = {}
