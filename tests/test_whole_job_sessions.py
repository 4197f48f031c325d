"""The rate limit keeps a bounded state, whatever a user's number of events."""

import random

import pyarrow as pa

from echolark.streaming import sessions


def plain(rows):
    out, logs = {}, {}
    for u, i, t in rows:
        log = [x for x in logs.get(u, []) if x > t - sessions.WINDOW_S * 1_000_000]
        out[i] = len(log) < sessions.LIMIT
        logs[u] = log + [t] * out[i]
    return out


def test_rate_limit_reads_a_hot_user_in_batches():
    rng = random.Random(6)
    users = [None] * 60 + [1] * 5000 + [2] * 300
    rows = [(u, i, t) for i, (u, t) in enumerate(sorted(((u, rng.randrange(10**6, 10**12)) for u in users), key=lambda x: (x[0] or 0, x[1])))]
    batches = (pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[n : n + 7]], pa.int64()) for k in range(3)], names=["user_id", "event_id", "t"]) for n in range(0, len(rows), 7))
    found = {}
    for b in sessions.judged(batches):
        assert b.num_rows <= 7
        found |= dict(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
    assert found == plain(rows) and len(set(found.values())) == 2


def test_rate_limit_needs_no_whole_group(spark, sf_dir):
    q = sessions.rate_limit(spark, sf_dir)
    assert "FlatMapGroupsInPandas" not in q._jdf.queryExecution().toString()
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id", "event_id", "unix_micros(cast(ts as timestamp)) as t").collect()
    assert {r.event_id: r.allowed for r in q.collect()} == plain(sorted(map(tuple, events), key=lambda r: (r[0], r[2], r[1])))
