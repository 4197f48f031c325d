"""Live sessions on streams: word distances by frame, words as they become stable, utterances that end by time.

State is a record a session of bounded size: counters, one column of warping costs for each prototype, one
score for each place of the expected labels and the moves that are not settled yet, or one utterance.
"""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from echolark.core import hold, read_table, shared_dir
from echolark.functions.warping import StreamLabels, StreamWarp
from echolark.plans.domain import VOICE_RMS, recordings
from echolark.streaming.replay import BatchFolder, drained, landed, replayed, streamed
from echolark.streaming.stateful import FRAME_MS, LEAST_FRAMES, MOST_FRAMES, REFRESH, WINDOW_FRAMES, KeyedSession, keyed

FRAMES, DIMS, EACH = 16, 4, 8
MOST_WORDS = 1_000
#: Least lead of the nearest word over the next for a verdict on the word (a fixed value).
MISMATCH_MARGIN = 0.08588068716048952


def recording_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings as frames of sessions of EACH: session_id, event_id, t (microseconds), feature, finish, target
    (the label of the first recording) and labels (of all, in order). Sessions run side by side."""
    e = read_table(spark, sf_dir, "embeddings").where(F.size("embedding") == FRAMES * DIMS)
    session = F.floor(F.col("vec_id") / EACH)
    rows = e.select(session.alias("session_id"), "vec_id", "label", F.posexplode(F.sequence(F.lit(0), F.lit(FRAMES - 1))).alias("k", "_"), "embedding")
    place = (F.col("vec_id") % EACH) * FRAMES + F.col("k")
    start = (F.col("session_id") % 50) * 1_000_000
    feature = F.transform(F.slice("embedding", F.col("k") * DIMS + 1, F.lit(DIMS)), lambda x: x.cast("double"))
    frames = rows.select("session_id", (F.col("vec_id") * FRAMES + F.col("k")).alias("event_id"), (start + place * FRAME_MS * 1000).alias("t"), feature.alias("feature"), F.lit(False).alias("finish"))
    order = F.sort_array(F.collect_list(F.struct("vec_id", "label")))
    about = e.groupBy(session.alias("session_id")).agg(order.alias("order")).select("session_id", F.transform("order", lambda x: x.label).alias("words"))
    last = (F.col("session_id") * EACH + EACH) * FRAMES
    ends = about.select("session_id", (-last).alias("event_id"), ((F.col("session_id") % 50) * 1_000_000 + EACH * FRAMES * FRAME_MS * 1000).alias("t"), F.lit(None).cast("array<double>").alias("feature"), F.lit(True).alias("finish"))
    return frames.union(ends).join(about, "session_id")


def word_prototypes(spark: SparkSession, sf_dir: str) -> dict[str, list[list[float]]]:
    """Of each word the mean of its training recordings, as FRAMES rows; the vocabulary is MOST_WORDS at most."""
    e = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("recording_id"), "embedding").where(F.size("embedding") == FRAMES * DIMS)
    t = recordings(spark, sf_dir).where("split = 'train'").select("recording_id", "word").join(e, "recording_id")
    means = F.array(*[F.avg(F.col("embedding")[k].cast("double")) for k in range(FRAMES * DIMS)])
    rows = t.groupBy("word").agg(means.alias("m")).limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} words")
    return {r.word: np.reshape(r.m, (FRAMES, DIMS)).tolist() for r in sorted(rows)}


def softmax(distances: np.ndarray) -> np.ndarray:
    p = np.exp(distances.min() - distances)
    return p / p.sum()


def final_verdict(duration_ms: int, voice_ratio: float, words: list[str], target: str | None, distances: np.ndarray | None) -> tuple[str, str]:
    """Status and reason of a session at its end, the first rule that holds: too little audio, no single target,
    no distances, the two nearest words too close, another word nearest; else a person is to look."""
    if duration_ms < 400 or voice_ratio < 0.1:
        return "RETRY", "AUDIO_INSUFFICIENT"
    if target is None:
        return "REVIEW_REQUIRED", "MULTI_WORD_REVIEW_REQUIRED"
    if distances is None or target not in words or np.isfinite(distances).sum() < 2:
        return "UNDECIDABLE", "WORD_IDENTITY_UNAVAILABLE"
    first, second = np.argsort(distances, kind="stable")[:2]
    if distances[second] - distances[first] < MISMATCH_MARGIN:
        return "UNDECIDABLE", "WORD_IDENTITY_UNCERTAIN"
    if words[first] != target:
        return "INCORRECT", "WRONG_WORD"
    return "REVIEW_REQUIRED", "PHONETIC_BACKEND_DISABLED"


class WordGate(KeyedSession):
    """Per-frame events with distances to every word.

    Each word's prototype is warped to all frames as they come; its distance is the least among paths that
    end in the last WINDOW_FRAMES frames. On a voiced frame at every REFRESH-th of LEAST_FRAMES or more, an
    inference is scheduled, unless one is under way; its distances are seen from the next frame on."""

    COLUMNS = ["t", "event_id", "feature", "finish", "words"]
    SCHEMA = "session_id long, event_id long, kind string, sequence int, elapsed_ms int, voice boolean, rms double, peak double, clipping boolean, scheduled boolean, refreshed boolean, closest string, distance double, confidence double, status string, reason string"
    STATE = "n int, voiced int, costs array<double>, lengths array<int>, ends array<double>, pending array<double>, latest array<double>, closed boolean, last long"

    def __init__(self, prototypes: dict[str, list[list[float]]]):
        self.words, self.rows = list(prototypes), np.array(list(prototypes.values()))

    def step(self, key, rows: Iterable[tuple], old: tuple | None) -> tuple[list[tuple], tuple]:
        n, voiced, costs, lengths, ends, pending, latest, closed, last = old or (0, 0, None, None, [], None, None, False, None)
        warp, kinds, out = StreamWarp(self.rows, costs, lengths), len(self.words), []
        ends = deque((np.array(ends[k : k + kinds]) for k in range(0, len(ends), kinds)), WINDOW_FRAMES)
        blank = (None,) * 9
        for t, event, feature, finish, words in rows:
            bad = pd.isna(t) or not finish and (feature is None or len(feature) != self.rows.shape[2] or not np.isfinite(np.asarray(feature, float)).all())
            if bad or (last is not None and t < last):
                out.append((key, event, "invalid" if bad else "late", None, None, *blank, None, None))
                continue
            last = int(t)
            if closed or (n >= MOST_FRAMES and not finish):
                out.append((key, event, "refused", None, None, *blank, "CLOSED" if closed else "TOO_LONG", None))
                continue
            ratio = voiced / n if n else 0.0
            if finish:
                closed = True
                held = np.min(ends, axis=0) if ends else None
                verdict = final_verdict(n * FRAME_MS, ratio, self.words, f"w{words[0]}" if len(words) else None, held)
                out.append((key, event, "final", n, n * FRAME_MS, None, None, None, None, None, None, *self._nearest(held), *verdict))
                continue
            x = np.asarray(feature, float)
            n, rms, peak = n + 1, float(np.sqrt((x * x).mean())), float(np.abs(x).max())
            voice = rms >= VOICE_RMS
            voiced += voice
            ends.append(warp.push(x))
            refreshed = pending is not None
            if refreshed:
                latest, pending = pending, None
            scheduled = voice and n >= LEAST_FRAMES and n % REFRESH == 0
            if scheduled:
                pending = np.min(ends, axis=0)
            out.append((key, event, "partial", n, n * FRAME_MS, voice, round(rms, 6), round(peak, 6), peak >= 0.99, scheduled, refreshed, *self._nearest(latest), None, None))
        flat = lambda a: None if a is None else [float(v) for v in a]
        return out, (n, voiced, warp.costs.ravel().tolist(), warp.lengths.ravel().tolist(), flat(np.concatenate(ends)) if ends else [], flat(pending), flat(latest), closed, last)

    def _nearest(self, distances) -> tuple[str | None, float | None, float | None]:
        if distances is None or not np.isfinite(np.asarray(distances, float)).any():
            return None, None, None
        d = np.asarray(distances, float)
        k = int(d.argmin())
        return self.words[k], round(float(d[k]), 6), round(float(softmax(d)[k]), 6)


class WordUpdates(KeyedSession):
    """Words of a known sentence, each told once, in order, once its place on the path is settled and its last
    label is STABLE_MS old; one a frame at most, and the rest at the finish marker."""

    COLUMNS = ["t", "event_id", "feature", "finish", "words"]
    SCHEMA = "session_id long, event_id long, word int, start_ms int, end_ms int, told_ms int, final boolean"
    STATE = "n int, scores binary, moves binary, settled int, starts array<int>, ends array<int>, place int, told int, closed boolean, last long"
    #: What is left of a session that has ended; its rows change nothing any more.
    ENDED = (0, None, None, 0, None, None, 0, 0, True, None)
    STABLE_MS, BEAM, SHARPNESS = 240, 30.0, 40.0

    @staticmethod
    def labels_of(word: int) -> list[int]:
        """Three labels from 1 to 3 that spell a word's number; 0 is the blank."""
        return [word % 3 + 1, word // 3 % 3 + 1, (word + 1) % 3 + 1]

    def step(self, key, rows: Iterable[tuple], old: tuple | None) -> tuple[list[tuple], tuple]:
        if old and old[8]:
            return [], self.ENDED
        n, scores, moves, settled, starts, ends, place, told, closed, last = old or (0, None, None, 0, [], [], 0, 0, False, None)
        starts, ends, out, path = list(starts), list(ends), [], None
        for t, event, feature, finish, words in rows:
            if pd.isna(t) or closed or (last is not None and t < last) or (not finish and (feature is None or not np.isfinite(np.asarray(feature, float)).all())):
                continue
            last = int(t)
            if path is None:
                path = StreamLabels([x for w in words for x in self.labels_of(int(w))], 0, self.BEAM, *(None if v is None else np.frombuffer(v, kind) for v, kind in ((scores, float), (moves, np.int8))))
            size = 2 * len(self.labels_of(0))
            if finish:
                certain, closed = path.finish(), True
            else:
                n += 1
                x = self.SHARPNESS * np.asarray(feature, float)
                x -= x.max()
                certain = path.push(x - np.log(np.exp(x).sum()))
            for at in certain:
                # place 2 k + 1 holds label k; a word is over where the path leaves its last label
                if at != place and place % size == size - 1:
                    ends.append(settled)
                if at % 2 and at != place and at % size == 1:
                    starts.append(settled)
                place, settled = at, settled + 1
            if closed and place % size == size - 1 and len(ends) < len(starts):
                ends.append(settled)
            while told < len(ends) and (closed or ends[told] * FRAME_MS <= n * FRAME_MS - self.STABLE_MS):
                out.append((key, event, told, starts[told] * FRAME_MS, ends[told] * FRAME_MS, n * FRAME_MS, closed))
                told += 1
                if not closed:
                    break
        if closed:
            return out, self.ENDED
        if path is not None:
            scores, moves = (None if path.scores is None else path.scores.tobytes()), np.array(path.kept(), np.int8).tobytes()
        return out, (n, scores, moves, settled, starts, ends, place, told, closed, last)


class Utterances(KeyedSession):
    """Runs of a key's events without a gap longer than `gap_s`. An utterance ends when a later event shows
    the gap, or by time: when the watermark has passed its last event by as much, its state goes."""

    COLUMNS = ["t", "voice"]
    SCHEMA = "user_id long, start_us long, end_us long, events long, voiced long, closed_by string"
    STATE = "start long, last long, n long, voiced long"

    def __init__(self, gap_s: int):
        self.gap = gap_s * 1_000_000

    def due(self, record: tuple) -> int:
        """The first millisecond behind the gap."""
        return (record[1] + self.gap) // 1000 + 1

    def ended(self, key, record: tuple) -> list[tuple]:
        return [(key, *record, "time")]

    def step(self, key, rows: Iterable[tuple], old: tuple | None) -> tuple[list[tuple], tuple]:
        open_, out = old, []
        for t, voice in rows:
            if open_ and t - open_[1] > self.gap:
                out.append((key, *open_, "event"))
                open_ = None
            start, last, n, voiced = open_ or (int(t), int(t), 0, 0)
            open_ = (min(start, int(t)), max(last, int(t)), n + 1, voiced + int(bool(voice)))
        return out, open_


def stream_word_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame of every session with its nearest word, and the verdict at its end."""
    return drained(keyed(replayed(recording_frames(spark, sf_dir), "t"), "session_id", WordGate(word_prototypes(spark, sf_dir))))


def stream_word_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every session as they become stable."""
    return drained(keyed(replayed(recording_frames(spark, sf_dir), "t"), "session_id", WordUpdates()))


GAP_S, DELAY = 21_600, "1 hour"


def utterance_stream(events: DataFrame, gap_s: int = GAP_S, delay: str = DELAY) -> DataFrame:
    """Utterances of events (user_id, event_id, ts, voice); rows without a time or a user are left out, rows that
    come later than `delay` behind the newest are late and do not count."""
    e = events.where("ts is not null and user_id is not null").withColumn("t", F.unix_micros("ts")).withWatermark("ts", delay)
    return keyed(e, "user_id", Utterances(gap_s), GroupStateTimeout.EventTimeTimeout)


def heartbeat(e: DataFrame) -> DataFrame:
    """e with a last row, of user -1, far behind all others: a source that has ended tells so, as time then passes for all."""
    last = e.agg((F.max("ts") + F.expr("interval 3650 days")).alias("ts")).select(F.lit(-1).cast("long").alias("user_id"), F.lit(-1).cast("long").alias("event_id"), "ts", F.lit(False).alias("voice"))
    return e.union(last)


def timed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("long").alias("user_id"), F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("value") / 500.0 >= VOICE_RMS).alias("voice"))


def stream_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances of every user, as the stream closes them."""
    found = drained(utterance_stream(replayed(heartbeat(timed_events(spark, sf_dir)), "ts")))
    return found.where("user_id <> -1").drop("closed_by")


def stream_consumer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events through a consumer that ends when nothing is left, and goes on from what its checkpoint has acknowledged
    when more has come; the second half is consumed so."""
    e = timed_events(spark, sf_dir).select("event_id", "user_id", "ts")
    folder = hold(spark, f"{shared_dir(spark)}/consumer-{uuid.uuid4().hex}")
    sink, log, path = BatchFolder(f"{folder}/out"), f"{folder}/log", None
    for half in (0, 1):
        path = landed(e.where(F.pmod("event_id", F.lit(2)) == half), "ts", path=path)
        drained(streamed(spark, path, e.schema), sink=sink, checkpoint=log)
    return sink.read(spark, e.schema).select("event_id", "user_id", F.unix_micros("ts").alias("t"))


QUERIES = {f.__name__: f for f in (stream_word_gate, stream_word_updates, stream_utterances, stream_consumer)}
ORACLE_SQL = {
    "stream_utterances": f"""WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS t, value / 500.0 >= {VOICE_RMS} AS voice FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
      g AS (SELECT *, CASE WHEN t - lag(t) OVER w > {GAP_S}000000 THEN 1 ELSE 0 END AS opens FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
      u AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM g)
      SELECT user_id, min(t) AS start_us, max(t) AS end_us, count(*) AS events, count_if(voice) AS voiced FROM u GROUP BY user_id, k""",
    "stream_consumer": "SELECT event_id, user_id, epoch_us(ts) AS t FROM events",
}
