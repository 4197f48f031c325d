"""Live sessions: stream kernels against whole tables and enumeration, sessions over several micro-batches, time and restarts."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_stateful import State

from echolark.functions.signal import ctc_path
from echolark.functions.warping import StreamLabels, StreamWarp, ending_distances, frame_costs
from echolark.streaming import live, stateful, stateful
from echolark.streaming.replay import BatchFolder, drained, landed, streamed


def run(session, batches, columns=("t", "event_id", "feature", "finish", "words")):
    state, out = State(), []
    for rows in batches:
        frame = pd.DataFrame(rows, columns=list(columns))
        out += [r for f in session((7,), iter([frame]), state) for r in f.itertuples(index=False)]
    return out


def every_path(prototype, frames, end):
    """The least mean cost among all paths of least cost that end at frame `end`, by trying each path."""
    cost, best = frame_costs(frames, prototype), []

    def go(i, j, total, steps):
        total, steps = total + cost[i, j], steps + 1
        if j == 0:
            best.append((total, steps))
            return
        go(i, j - 1, total, steps)
        if i:
            go(i - 1, j, total, steps)
            go(i - 1, j - 1, total, steps)

    go(end, len(prototype) - 1, 0.0, 0)
    total, steps = min((round(t, 12), s) for t, s in best)
    return total / steps


def test_stream_warp_is_the_table_and_the_best_path():
    rng = np.random.default_rng(2)
    prototypes, frames = rng.normal(size=(3, 4, 2)), rng.normal(size=(6, 2))
    frames[2] = 0
    warp, seen = StreamWarp(prototypes), []
    for frame in frames:
        seen.append(warp.push(frame))
        warp = StreamWarp(prototypes, warp.costs.ravel().tolist(), warp.lengths.ravel().tolist())
    for k, prototype in enumerate(prototypes):
        table = ending_distances(prototype, frames)
        assert np.allclose([s[k] for s in seen], table)
        assert np.allclose(table, [every_path(prototype, frames, i) for i in range(6)])


def gate_rows(n=70, seed=1):
    rng = np.random.default_rng(seed)
    return [(k * 40, k, rng.normal(size=4).tolist(), False, [0, 1]) for k in range(n)]


def prototypes():
    rng = np.random.default_rng(3)
    return {f"w{k}": rng.normal(size=(5, 4)).tolist() for k in range(3)}


def test_gate_equals_the_batch_kernel_at_each_refresh_over_batches():
    rows, words = gate_rows() + [(70 * 40, 70, None, True, [0, 1])], prototypes()
    whole = run(live.WordGate(words), [rows])
    parts = run(live.WordGate(words), [rows[:3][::-1], rows[3:11], rows[11:52], rows[52:]])
    assert [tuple(map(str, r)) for r in whole] == [tuple(map(str, r)) for r in parts]
    frames = np.array([r[2] for r in rows[:-1]])
    tables = np.array([ending_distances(np.array(p), frames) for p in words.values()])
    refreshed = [r for r in whole if r.kind == "partial" and r.refreshed]
    assert [r.sequence for r in refreshed] == list(range(11, 71, 5))
    for r in refreshed:
        held = tables[:, max(0, r.sequence - 1 - 40) : r.sequence - 1].min(axis=1)
        assert r.closest == f"w{held.argmin()}" and r.distance == pytest.approx(held.min(), abs=1e-6)
        assert r.confidence == pytest.approx(np.exp(-held.min()) / np.exp(-held).sum(), abs=1e-6)
    assert whole[-1].kind == "final" and whole[-1].distance == pytest.approx(tables[:, -40:].min(), abs=1e-6)


def test_rows_without_time_or_values_are_invalid():
    rows = gate_rows(12)
    odd = [(None, 90, [1.0] * 4, False, [0]), (500, 91, None, False, [0]), (500, 92, [np.nan] * 4, False, [0]), (500, 93, [1.0], False, [0])]
    out = run(live.WordGate(prototypes()), [rows[:6] + odd, rows[6:] + [(5, 94, [1.0] * 4, False, [0])]])
    kinds = {r.event_id: r.kind for r in out}
    assert all(kinds[k] == "invalid" for k in range(90, 94)) and kinds[94] == "late" and len(out) == 17
    old = run(stateful.FrameSession(), [[(None, 1, 0.5, False), (40, 2, 0.5, False), (80, 3, None, False)]], ("t", "event_id", "rms", "finish"))
    assert sorted((r.event_id, r.kind) for r in old) == [(1, "invalid"), (2, "partial"), (3, "invalid")]
    assert [r.kind for r in run(stateful.SentenceSession([[1.0, 0, 0]], 1, 0.2, 0.1), [[(None, 1, 0.5, False)]], ("t", "event_id", "rms", "finish"))] == ["invalid"]
    assert len(run(stateful.RateLimit(2, 10), [[(None, 1, 0.5, False), (3, 2, 0.5, False)]], ("t", "event_id", "rms", "finish"))) == 2


def test_verdicts_in_order():
    near, far = np.array([0.1, 0.5, 0.9]), np.array([0.1, 0.15, 0.9])
    words = ["w0", "w1", "w2"]
    cases = [(360, 1.0, "w0", near), (800, 0.05, "w0", near), (800, 1.0, None, near), (800, 1.0, "w9", near), (800, 1.0, "w0", None), (800, 1.0, "w0", far), (800, 1.0, "w1", near), (800, 1.0, "w0", near)]
    reasons = ["AUDIO_INSUFFICIENT"] * 2 + ["MULTI_WORD_REVIEW_REQUIRED"] + ["WORD_IDENTITY_UNAVAILABLE"] * 2 + ["WORD_IDENTITY_UNCERTAIN", "WRONG_WORD", "PHONETIC_BACKEND_DISABLED"]
    assert [live.final_verdict(d, v, words, t, x)[1] for d, v, t, x in cases] == reasons


def test_labels_without_a_beam_are_viterbi():
    rng = np.random.default_rng(4)
    for _ in range(20):
        labels = rng.integers(1, 4, rng.integers(1, 5)).tolist()
        x = np.log(rng.dirichlet(np.ones(4) / 2, 12))
        path, found = StreamLabels(labels), []
        for row in x:
            found += path.push(row)
            path = StreamLabels(labels, 0, np.inf, path.scores.tolist(), path.kept())
        assert found + path.finish() == ctc_path(x, labels).tolist()


def shared_prefix(x, labels, t):
    """What the best paths to every place at frame t have in common, by trying all paths."""
    places = [0] + [v for k in labels for v in (k, 0)]
    best = {}
    for path in itertools.product(range(len(places)), repeat=t + 1):
        steps = [b - a for a, b in zip(path, path[1:])]
        if path[0] > 1 or any(s not in (0, 1, 2) for s in steps):
            continue
        if any(s == 2 and (places[b] == 0 or places[b] == places[b - 2]) for s, b in zip(steps, path[1:])):
            continue
        score = sum(x[i][places[p]] for i, p in enumerate(path))
        if score > -np.inf and score > best.get(path[-1], (-np.inf,))[0]:
            best[path[-1]] = (score, path)
    paths = [p for _, p in best.values()]
    n = 0
    while n <= t and len({p[n] for p in paths}) == 1:
        n += 1
    return list(paths[0][:n])


def test_what_is_given_out_is_what_all_live_paths_share():
    rng = np.random.default_rng(6)
    given = 0
    for _ in range(12):
        x = np.log(rng.dirichlet(np.ones(3), 5))
        x[1, 0] = x[3, 2] = -np.inf  # places that no path can be in
        path, found = StreamLabels([1, 2]), []
        for t, row in enumerate(x):
            found += path.push(row)
            assert found == shared_prefix(x, [1, 2], t)
        given += len(found)
    assert given


def spoken(words, frames_each=6):
    """Evidence in which each label of each word lasts so many frames, with a blank frame between."""
    rows = []
    for w in words:
        for label in live.WordUpdates.labels_of(w):
            rows += [[0.1 if k != label else 0.9 for k in range(4)]] * frames_each + [[0.9, 0.1, 0.1, 0.1]]
    return [(k * 40, k, x, False, words) for k, x in enumerate(rows)]


def test_words_leave_once_in_order_and_stable():
    words = [4, 0, 7, 7]
    rows = spoken(words)
    whole = run(live.WordUpdates(), [rows + [(10**6, 999, None, True, words)]])
    parts = run(live.WordUpdates(), [rows[:10], rows[10:33], rows[33:], [(10**6, 999, None, True, words)]])
    assert [tuple(r) for r in whole] == [tuple(r) for r in parts]
    assert [r.word for r in whole] == [0, 1, 2, 3]
    for k, r in enumerate(whole):
        assert r.start_ms == k * 21 * 40 and abs(r.end_ms - (k * 21 + 20) * 40) <= 40
        assert r.final or r.told_ms >= r.end_ms + 240
    assert not any(r.final for r in whole[:3]) and len({r.event_id for r in whole[:3]}) == 3


EVENTS = "user_id long, event_id long, ts timestamp, voice boolean"


def events(spark, rows):
    df = spark.createDataFrame([(u, i, t, v) for u, i, t, v in rows], "user_id long, event_id long, s long, voice boolean")
    return df.select("user_id", "event_id", F.timestamp_seconds("s").alias("ts"), "voice")


def test_time_ends_utterances_and_frees_their_state(spark, tmp_path):
    rows = [(1, k, 1000 + k * 10, True) for k in range(5)] + [(1, 9, 2000, False), (2, 10, 1010, True), (3, 11, None, True), (None, 12, 1000, True), (9, 99, 10**6, False)]
    e, told = events(spark, rows), []
    path = landed(e, "ts")
    found = drained(live.utterance_stream(streamed(spark, path, EVENTS), 100, "10 seconds"), told=told).collect()
    got = {(r.user_id, r.start_us // 10**6, r.end_us // 10**6, r.events, r.voiced) for r in found}
    assert got == {(1, 1000, 1040, 5, 5), (1, 2000, 2000, 1, 0), (2, 1010, 1010, 1, 1)}  # the last user's is still open
    assert any(r.closed_by == "time" for r in found)
    assert told[-1].stateOperators[0].numRowsTotal == 1 and len([p for p in told if p.numInputRows]) >= 3


def test_keys_of_one_bucket_end_by_their_own_times(spark, monkeypatch):
    monkeypatch.setattr(stateful, "BUCKETS", 1)
    rows = [(u, 100 * u + k, 1000 + 300 * (u % 3) + k * 10, True) for u in range(30) for k in range(4)] + [(40, 5000, 1500, True), (41, 5001, 10**6, False)]
    e, told = events(spark, rows), []
    found = drained(live.utterance_stream(streamed(spark, landed(e, "ts", 6), EVENTS), 100, "10 seconds"), told=told).collect()
    got = sorted((r.user_id, r.start_us // 10**6, r.events) for r in found)
    assert got == sorted([(u, 1000 + 300 * (u % 3), 4) for u in range(30)] + [(40, 1500, 1)])
    assert max(p.stateOperators[0].numRowsTotal for p in told if p.stateOperators) == 1


def test_late_rows_do_not_count(spark, tmp_path):
    folder, log = str(tmp_path / "in"), str(tmp_path / "log")
    batches = [[(1, 1, 1000, True)], [(2, 2, 5000, True)], [(1, 3, 1050, True), (2, 4, 5050, True)], [(9, 99, 10**6, False)]]
    out = []
    for rows in batches:
        events(spark, rows).coalesce(1).write.mode("append").parquet(folder)
        stream = live.utterance_stream(streamed(spark, folder, EVENTS), 100, "10 seconds")
        drained(stream, sink=lambda b, k: out.extend(b.collect()), checkpoint=log)  # each run goes on where the last one ended
    got = sorted((r.user_id, r.start_us // 10**6, r.events) for r in out)
    assert got == [(1, 1000, 1), (2, 5000, 2)]


def test_a_batch_that_fails_is_neither_lost_nor_doubled(spark, tmp_path):
    rows = [(k % 3, k, 1000 + k, True) for k in range(40)]
    stream = streamed(spark, landed(events(spark, rows), "ts"), EVENTS)
    sink, log, seen = BatchFolder(str(tmp_path / "out")), str(tmp_path / "log"), []

    def fails(batch, k):
        seen.append(k)
        if k == 2:
            batch.limit(3).write.mode("overwrite").parquet(f"{sink.path}/batch={k}")  # part of it is written
            raise RuntimeError("the machine went away")
        sink(batch, k)

    with pytest.raises(Exception, match="the machine went away"):
        drained(stream, sink=fails, checkpoint=log)
    assert seen == [0, 1, 2] and sink.read(spark, EVENTS).count() < 40
    drained(stream, sink=sink, checkpoint=log)
    assert sorted(r.event_id for r in sink.read(spark, EVENTS).collect()) == list(range(40))
    drained(stream, sink=sink, checkpoint=log)  # nothing new
    assert sink.read(spark, EVENTS).count() == 40


def test_queries_have_several_micro_batches(spark, sf_dir):
    from echolark.streaming.replay import events_stream

    told = []
    drained(events_stream(spark, sf_dir).select("event_id"), told=told)
    assert len([p for p in told if p.numInputRows]) >= 4
