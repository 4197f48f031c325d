"""Keyed sessions over several micro-batches, late rows, and the online aligner."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from echolark.functions.alignment import OnlineAligner, cosine_costs
from echolark.streaming import sessions, stateful
from echolark.streaming.replay import drained, replayed


class State:
    """What a session sees of its state."""

    def __init__(self):
        self.getOption = None

    def update(self, values):
        self.getOption = values


def run(session, batches):
    state, out = State(), []
    for rows in batches:
        frame = pd.DataFrame(rows, columns=["t", "event_id", "rms", "finish"])
        out += [r for f in session((7,), iter([frame]), state) for r in f.itertuples(index=False)]
    return out


def frames(n, rms=0.5):
    return [(k * 40, k, rms, False) for k in range(n)]


def test_batches_make_no_difference():
    rows = frames(60) + [(60 * 40, 60, 0.0, True), (61 * 40, 61, 0.5, False)]
    whole = run(stateful.FrameSession(), [rows])
    parts = run(stateful.FrameSession(), [rows[:7][::-1], rows[7:31], rows[31:]])
    assert [tuple(map(str, r)) for r in whole] == [tuple(map(str, r)) for r in parts]
    assert [r.kind for r in whole[-2:]] == ["final", "refused"] and whole[-2].status == "SCORED" and whole[-1].status == "CLOSED"
    assert [r.sequence for r in whole if r.kind == "partial" and r.scheduled] == list(range(10, 61, 5))
    assert [r.sequence for r in whole if r.kind == "partial" and r.refreshed] == list(range(11, 61, 5))


def test_late_rows_are_told_apart():
    out = run(stateful.FrameSession(), [frames(5), [(40, 99, 0.5, False), (400, 100, 0.5, False)]])
    assert [(r.event_id, r.kind) for r in out[5:]] == [(99, "late"), (100, "partial")] and out[-1].sequence == 6


def test_long_sessions_are_refused_and_silent_ones_retried():
    out = run(stateful.FrameSession(), [frames(377)])
    assert [r.status for r in out[-2:]] == ["TOO_LONG", "TOO_LONG"]
    out = run(stateful.FrameSession(), [frames(20, 0.0) + [(900, 50, 0.0, True)]])
    assert out[-1].status == "RETRY" and out[-1].voice_ratio == 0


def test_rate_limit_by_state():
    times = [0, 1, 2, 11]
    out = run(stateful.RateLimit(2, 10), [[(t * 1_000_000, t, 0.0, False)] for t in times])
    assert [bool(r.allowed) for r in out] == [True, True, False, True]


def test_stream_and_batch_limits_agree(spark, sf_dir):
    key = lambda df: {(r.user_id, r.event_id): r.allowed for r in df.collect()}
    assert key(stateful.stream_rate_limit(spark, sf_dir)) == key(sessions.rate_limit(spark, sf_dir))


def least_cost(frames, reference):
    """The cost a step of the cheapest path to each reference row, by trying every path."""
    best = {}

    def go(i, j, cost):
        cost += cosine_costs(frames[i], reference)[j]
        if i == len(frames) - 1:
            best[j] = min(best.get(j, np.inf), cost / len(frames))
            return
        for k in (j, j + 1):
            if k < len(reference):
                go(i + 1, k, cost)

    go(0, 0, 0.0)
    return best


def test_online_aligner_finds_the_cheapest_path():
    rng = np.random.default_rng(5)
    reference, seen = rng.normal(size=(4, 3)), rng.normal(size=(7, 3))
    aligner = OnlineAligner(reference)
    for k, frame in enumerate(seen):
        at, _ = aligner.push(frame)
        aligner = OnlineAligner(reference, aligner.costs.tolist(), aligner.lengths.tolist())
        best = least_cost(seen[: k + 1], reference)
        assert best[at] == pytest.approx(min(best.values()))
    assert aligner.final_distance() == pytest.approx(best[3])
    assert OnlineAligner(reference).final_distance() == float("inf")


def test_a_sentence_error_is_told_once_in_a_unit():
    reference = [[1.0, 0.0, 0.0]] * 4
    session = stateful.SentenceSession(reference, 2, 0.2, 0.1)
    loud = [(k, k, x, False) for k, x in enumerate([0.2, 0.9, 0.1, 0.8, -0.9] * 4)]
    out = run(session, [loud[:8], loud[8:], [(99, 99, 0.0, True)]])
    kinds = [r.kind for r in out]
    assert kinds.count("listening") == 20 and kinds.count("alignment") == 4 and kinds[-1] == "evaluated"
    errors = [r for r in out if r.kind == "error"]
    assert errors and len({r.unit for r in errors}) == len(errors) and out[-1].status == "INCORRECT"
    silent = run(session, [[(k, k, 0.0, False) for k in range(10)] + [(20, 20, 0.0, True)]])
    assert [r.kind for r in silent].count("alignment") == 0 and silent[-1].status == "RETRY"


class Held:
    """The state of a bucket."""

    def __init__(self):
        self.getOption, self.exists, self.hasTimedOut = None, False, False

    def update(self, values):
        self.getOption, self.exists = values, True


def test_a_call_serves_all_keys_of_a_bucket():
    rng = np.random.default_rng(9)
    rows = [(k * 40, k, float(x), k % 23 == 0) for k, x in enumerate(rng.random(600))]
    keys = rng.integers(0, 40, 600).tolist()
    for make in (lambda: stateful.RateLimit(3, 5), stateful.FrameSession, lambda: stateful.SentenceSession([[1.0, 0.0, 0.0]] * 4, 2, 0.2, 0.1)):
        cuts = [slice(0, 200), slice(200, 600)]
        alone = [str(tuple(r[1:])) for k in range(40) for r in run(make(), [[x for x, of in zip(rows[c], keys[c], strict=True) if of == k] for c in cuts])]
        bucket, state, out = stateful.Buckets(make()), Held(), []
        for c in cuts:
            frame = pd.DataFrame(rows[c], columns=["t", "event_id", "rms", "finish"]).assign(_key=[max(k, 1) for k in keys[c]], _null=[k == 0 for k in keys[c]])
            out += [r for f in bucket((5,), iter([frame.sample(frac=1, random_state=1)]), state) for r in f.itertuples(index=False)]
        assert sorted(str(tuple(r[1:])) for r in out if pd.isna(r[0]) or r[0] != 1) == sorted(str(tuple(r[1:])) for k in range(40) if k != 1 for r in run(make(), [[x for x, of in zip(rows[c], keys[c], strict=True) if of == k] for c in cuts]))
        assert len(out) == len(alone) and len(state.getOption[0]) == 40 and None in state.getOption[0]


def test_many_keys_make_no_more_calls_than_buckets(spark):
    rows = spark.range(6000).select((F.col("id") % 3000).alias("user_id"), F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"))
    told, stream = [], replayed(rows, "ts", 2)
    out = drained(stateful.keyed(stream.withColumn("t", F.unix_micros("ts")), "user_id", stateful.RateLimit(1, 10**6)), told=told)
    assert out.where("allowed").count() == 3000 and out.count() == 6000
    assert told[-1].stateOperators[0].numRowsTotal <= stateful.BUCKETS
