"""Keyed state on streams: frame sessions, rate limits and sentence sessions.

State is one small record a key: counters, the last frames of the rolling window, the last passes, or
one row of the alignment. A call of a Python function of its own for every key and micro-batch costs far
more than the rows it reads, so keys are dealt over BUCKETS by hash and a call has all keys of a bucket; its
state is the list of their records. Within a micro-batch a key's rows are put in order of time;
a row older than the last one read of its key is late and is told apart, not counted. Micro-batches
bound what is sorted at once: sources should limit files or bytes a trigger.
"""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from echolark.core import hold, shared_dir
from echolark.functions.alignment import OnlineAligner
from echolark.plans.domain import FRAMES_SQL, VOICE_RMS
from echolark.streaming.replay import BatchFolder, drained, events_stream

FRAME_MS, WINDOW_FRAMES, LEAST_FRAMES, REFRESH, MOST_FRAMES = 40, 40, 10, 5, 375
FINISH_EVERY = 97
BUCKETS = 1_024


def in_order(rows: Iterator[pd.DataFrame], by: Sequence[str] = ("t", "event_id")) -> pd.DataFrame:
    """A group's rows of one micro-batch by time and id; rows without a time come last, with NaN for it."""
    found = [r for r in rows if len(r)]
    return pd.concat(found).sort_values(list(by), kind="stable") if found else pd.DataFrame(columns=list(by))


class KeyedSession:
    """What is done with a key's rows: step() takes the key, its rows (COLUMNS) in order and its state (None at
    first), and gives the rows that come out and the new state. Called, a session serves one key."""

    COLUMNS = ["t", "event_id", "rms", "finish"]

    def step(self, key, rows: Iterable[tuple], old: tuple | None) -> tuple[list[tuple], tuple]:
        raise NotImplementedError

    def __call__(self, key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out, new = self.step(key[0], listed(in_order(rows), self.COLUMNS), state.getOption)
        state.update(new)
        yield frame_of(out, self.SCHEMA)


def listed(rows: pd.DataFrame, columns: list[str]) -> list[tuple]:
    return list(zip(*[rows[c].tolist() for c in columns], strict=True)) if len(rows) else []


class Buckets:
    """A session over all keys of a bucket. Where sessions end by time (they have `due`), a bucket waits for the
    first of its keys; those whose time has come and that have no new rows end, the others stay."""

    def __init__(self, session: KeyedSession):
        self.session = session
        self.SCHEMA, self.STATE = session.SCHEMA, f"keys array<long>, records array<struct<{session.STATE}>>"

    def __call__(self, key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        session, out = self.session, []
        held = dict(zip(*state.getOption, strict=True)) if state.exists else {}
        seen: dict = {}
        if not state.hasTimedOut:
            r = in_order(rows, ("_null", "_key", "t", "event_id"))
            of = zip(r["_null"].tolist(), r["_key"].tolist(), strict=True) if len(r) else ()
            for (null, k), row in zip(of, listed(r, session.COLUMNS), strict=True):
                seen.setdefault(None if null else k, []).append(row)
        timed = hasattr(session, "due")
        now = state.getCurrentWatermarkMs() if timed else 0
        if timed:
            for k in [k for k, old in held.items() if k not in seen and session.due(old) < now]:
                out += session.ended(k, held.pop(k))
        for k, its in seen.items():
            found, held[k] = session.step(k, its, held.get(k))
            out += found
        if held:
            state.update((list(held), [tuple(r) for r in held.values()]))
            if timed:
                state.setTimeoutTimestamp(max(min(map(session.due, held.values())), now + 1))
        elif state.exists:
            state.remove()
        yield frame_of(out, session.SCHEMA)


class FrameSession(KeyedSession):
    """Per-frame events of a session.

    One inference at most is under way: it is scheduled on a voiced frame at every REFRESH-th frame of a
    window of LEAST_FRAMES or more, and its result (the window's mean level) is seen from the next frame
    on. A finish marker closes the session with a final event; frames behind it, and frames beyond
    MOST_FRAMES, are refused. Rows without a time, and frames without a level, are invalid and change nothing."""

    SCHEMA = "session_id long, event_id long, kind string, sequence int, elapsed_ms int, voice boolean, scheduled boolean, refreshed boolean, level double, voice_ratio double, status string"
    STATE = "n int, voiced int, pending boolean, waiting double, level double, closed boolean, last long, window array<double>"

    def step(self, key, rows: Iterable[tuple], old: tuple | None) -> tuple[list[tuple], tuple]:
        n, voiced, pending, waiting, level, closed, last, window = old or (0, 0, False, None, None, False, None, [])
        window = deque(window, WINDOW_FRAMES)
        out = []
        for t, event, rms, finish in rows:
            if pd.isna(t) or (pd.isna(rms) and not finish) or (last is not None and t < last):
                kind = "invalid" if pd.isna(t) or (pd.isna(rms) and not finish) else "late"
                out.append((key, event, kind, None, None, None, None, None, None, None, None))
                continue
            last = int(t)
            if closed or n >= MOST_FRAMES:
                out.append((key, event, "refused", None, None, None, None, None, None, None, "CLOSED" if closed else "TOO_LONG"))
                continue
            if finish:
                closed = True
                ratio = voiced / n if n else 0.0
                status = "RETRY" if n * FRAME_MS < 400 or ratio < 0.1 else "SCORED"
                out.append((key, event, "final", n, n * FRAME_MS, None, None, None, level, ratio, status))
                continue
            n, voice = n + 1, bool(rms >= VOICE_RMS)
            voiced += voice
            window.append(rms)
            refreshed = pending
            if pending:
                level, pending = waiting, False
            scheduled = voice and len(window) >= LEAST_FRAMES and n % REFRESH == 0
            if scheduled:
                pending, waiting = True, float(np.mean(window))
            out.append((key, event, "partial", n, n * FRAME_MS, voice, scheduled, refreshed, level, voiced / n, None))
        return out, (n, voiced, pending, waiting, level, closed, last, [float(x) for x in window])


class RateLimit(KeyedSession):
    """Whether each event passes: fewer than `limit` passed in the last `seconds`. State: the last passes."""

    COLUMNS = ["t", "event_id"]
    SCHEMA = "user_id long, event_id long, allowed boolean"
    STATE = "t array<long>"

    def __init__(self, limit: int, seconds: int):
        self.limit, self.span = limit, seconds * 1_000_000

    def step(self, key, rows: Iterable[tuple], old: tuple | None) -> tuple[list[tuple], tuple]:
        log = deque((old or ([],))[0])
        out = []
        for t, event in rows:
            while not pd.isna(t) and log and log[0] <= t - self.span:
                log.popleft()
            out.append((key, event, len(log) < self.limit))
            if out[-1][2] and not pd.isna(t):
                log.append(int(t))
        return out, (list(log),)


class SentenceSession(KeyedSession):
    """Listening at every frame, alignment at every fifth (a chunk), leading silence skipped, an error on
    exactly the second bad chunk in a row of one unit, and the verdict at the finish marker."""

    SCHEMA = "session_id long, event_id long, kind string, sequence int, position int, unit int, local_distance double, status string"
    CHUNK, CONFIRM = 5, 2

    def __init__(self, reference: list[list[float]], units: int, error: float, final: float):
        self.reference, self.units, self.error, self.final = reference, units, error, final

    STATE = "n int, chunk array<double>, costs array<double>, lengths array<int>, observed int, bad int, unit int, closed boolean, last long"

    def step(self, key, rows: Iterable[tuple], old: tuple | None) -> tuple[list[tuple], tuple]:
        n, chunk, costs, lengths, observed, bad, unit, closed, last = old or (0, [], None, None, 0, 0, -1, False, None)
        aligner, chunk, out = OnlineAligner(np.array(self.reference), costs, lengths), list(chunk), []
        for t, event, rms, finish in rows:
            invalid = pd.isna(t) or (pd.isna(rms) and not finish)
            if invalid or closed or (last is not None and t < last):
                out.append((key, event, "invalid" if invalid else "refused" if closed else "late", n, None, None, None, None))
                continue
            last = int(t)
            if finish:
                closed, d = True, aligner.final_distance()
                status = "RETRY" if not np.isfinite(d) else "CORRECT" if d <= self.final else "INCORRECT"
                out.append((key, event, "evaluated", n, None, None, round(d, 6) if np.isfinite(d) else None, status))
                continue
            n += 1
            chunk.append(float(rms))
            out.append((key, event, "listening", n, None, None, None, None))
            if len(chunk) < self.CHUNK:
                continue
            x, chunk = np.array(chunk), []
            if not observed and np.sqrt((x * x).mean()) < VOICE_RMS:
                continue
            place, local = aligner.push(features(x))
            observed += 1
            here = place * self.units // len(self.reference)
            out.append((key, event, "alignment", n, place, here, round(local, 6), None))
            if local <= self.error:
                bad, unit = 0, -1
                continue
            bad, unit = (bad + 1, unit) if here == unit else (1, here)
            if bad == self.CONFIRM:
                out.append((key, event, "error", n, place, here, round(local, 6), "INCORRECT"))
        return out, (n, chunk, aligner.costs.tolist(), aligner.lengths.tolist(), observed, bad, unit, closed, last)


def features(chunk: np.ndarray) -> np.ndarray:
    """Level, spread and slope of a chunk of levels."""
    return np.array([chunk.mean(), chunk.std(), chunk[-1] - chunk[0]])


KINDS = {"long": "Int64", "int": "Int32", "double": "float64", "boolean": "boolean", "string": "object"}


def frame_of(rows: list[tuple], schema: str) -> pd.DataFrame:
    fields = [c.split(" ") for c in schema.split(", ")]
    out = pd.DataFrame(rows, columns=[n for n, _ in fields])
    return out.astype({n: KINDS[k] for n, k in fields})


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames in the stream; an event in FINISH_EVERY is a finish marker."""
    finish = (F.col("event_id") % FINISH_EVERY == 0).alias("finish")
    return events_stream(spark, sf_dir).select(F.col("user_id").alias("session_id"), "event_id", F.unix_micros("ts").alias("t"), (F.col("value") / 500.0).alias("rms"), finish)


def keyed(stream: DataFrame, key: str, session: KeyedSession, timeout: str = GroupStateTimeout.NoTimeout) -> DataFrame:
    """What a session gives for every key (a long, null too) of a stream."""
    of = stream.withColumns({"_null": F.col(key).isNull(), "_key": F.coalesce(F.col(key).cast("long"), F.lit(0)), "_bucket": F.pmod(F.xxhash64(F.lit("bucket"), key), F.lit(BUCKETS))})
    buckets = Buckets(session)
    return of.groupBy("_bucket").applyInPandasWithState(buckets, buckets.SCHEMA, buckets.STATE, "append", timeout)


def stream_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial, final and refused events of every session."""
    out = drained(keyed(_timed(spark, sf_dir), "session_id", FrameSession()))
    return out.withColumns({"level": F.round(F.col("level") + 1e-9, 6), "voice_ratio": F.round(F.col("voice_ratio") + 1e-9, 4)})


def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sliding log of passes of each user, kept as state of the stream."""
    s = _timed(spark, sf_dir).withColumnRenamed("session_id", "user_id")
    return drained(keyed(s, "user_id", RateLimit(20, 86_400)))


SENTENCE = [[0.2, 0.05, 0.1], [0.35, 0.1, 0.15], [0.3, 0.12, -0.2], [0.15, 0.1, -0.1], [0.25, 0.15, 0.3], [0.2, 0.1, -0.3]]


def stream_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session read against one sentence of six positions in three units."""
    return drained(keyed(_timed(spark, sf_dir), "session_id", SentenceSession(SENTENCE, 3, 0.35, 0.2)))


def stream_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the stream in two sinks: all of them, and those to audit. Each batch overwrites its own
    folder, so that a batch that runs again after a failure leaves no doubles. Returns what the sinks hold."""
    path = hold(spark, f"{shared_dir(spark)}/fanout-{uuid.uuid4().hex}")
    kept = {"events": BatchFolder(f"{path}/events"), "audit": BatchFolder(f"{path}/audit")}

    def write(batch: DataFrame, k: int) -> None:
        kept["events"](batch, k)
        kept["audit"](batch.where("event_type in ('error', 'purchase')"), k)

    drained(events_stream(spark, sf_dir).select("event_id", "user_id", "event_type"), sink=write)
    sinks = [sink.read(spark, "event_id long, user_id long, event_type string").withColumn("sink", F.lit(s)) for s, sink in kept.items()]
    return sinks[0].union(sinks[1]).groupBy("sink", "event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("ids"))


QUERIES = {f.__name__: f for f in (stream_frames, stream_rate_limit, stream_sentences, stream_fanout)}
ORACLE_SQL = {
    "stream_frames": FRAMES_SQL.replace("FROM events)", f"""FROM events WHERE event_id % {FINISH_EVERY} <> 0),
      ev AS (SELECT user_id AS session_id, event_id, ts, value / 500.0 AS rms, event_id % {FINISH_EVERY} = 0 AS finish FROM events),
      c AS (SELECT *, coalesce(sum(CASE WHEN finish THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS closed FROM ev),
      n AS (SELECT *, sum(CASE WHEN closed OR finish THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS k FROM c),
      v AS (SELECT *, CASE WHEN closed THEN 'refused' WHEN k > 375 OR (finish AND k >= 375) THEN 'refused' WHEN finish THEN 'final' ELSE 'partial' END AS kind FROM n),
      p AS (SELECT *, rms >= 0.1 AS voice, rms >= 0.1 AND k >= 10 AND k % 5 = 0 AS scheduled, avg(rms) OVER w AS mean, avg(CASE WHEN rms >= 0.1 THEN 1.0 ELSE 0.0 END) OVER a AS ratio FROM v WHERE kind = 'partial'
        WINDOW w AS (PARTITION BY session_id ORDER BY k ROWS BETWEEN 39 PRECEDING AND CURRENT ROW), a AS (PARTITION BY session_id ORDER BY k)),
      q AS (SELECT *, coalesce(lag(scheduled) OVER s, false) AS refreshed, last_value(CASE WHEN scheduled THEN mean END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS level FROM p WINDOW s AS (PARTITION BY session_id ORDER BY k)),
      e AS (SELECT f.session_id, f.event_id, f.k, q.level, q.ratio FROM v f LEFT JOIN q ON q.session_id = f.session_id AND q.k = f.k WHERE f.kind = 'final')""")
    + """ SELECT session_id, event_id, kind, CAST(k AS INT) AS sequence, CAST(k * 40 AS INT) AS elapsed_ms, voice, scheduled, refreshed, round(level + 1e-9, 6) AS level, round(ratio + 1e-9, 4) AS voice_ratio, NULL AS status FROM q
      UNION ALL SELECT session_id, event_id, 'final', CAST(k AS INT), CAST(k * 40 AS INT), NULL, NULL, NULL, round(level + 1e-9, 6), round(coalesce(ratio, 0) + 1e-9, 4), CASE WHEN k * 40 < 400 OR coalesce(ratio, 0) < 0.1 THEN 'RETRY' ELSE 'SCORED' END FROM e
      UNION ALL SELECT session_id, event_id, 'refused', NULL, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN closed THEN 'CLOSED' ELSE 'TOO_LONG' END FROM v WHERE kind = 'refused'""",
    "stream_fanout": "WITH s AS (SELECT 'events' AS sink, * FROM events UNION ALL SELECT 'audit', * FROM events WHERE event_type IN ('error', 'purchase')) SELECT sink, event_type, count(*) AS n, count(DISTINCT event_id) AS ids FROM s GROUP BY 1, 2",
}
