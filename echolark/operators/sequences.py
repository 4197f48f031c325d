"""Frames in order: contiguity, rolling windows, runs, segments, debounce and range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echolark.core import read_table, staged
from echolark.operators.selection import exact_quantiles
from echolark.plans.domain import FRAMES_SQL, frames


def by_session():
    return Window.partitionBy("session_id").orderBy("sequence")


def run_id(flag: Column) -> Column:
    """A number for each maximal run of one flag value within a session."""
    return F.sum(F.when(flag == F.lag(flag).over(by_session()), 0).otherwise(1)).over(by_session().rowsBetween(Window.unboundedPreceding, 0))


def frame_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "conversations")
    n = F.count(F.lit(1))
    ok = (F.max("turn") - F.min("turn") + 1 == n) & (F.countDistinct("turn") == n)
    return c.groupBy("conv_id").agg(F.min("turn").alias("first"), n.alias("n"), ok.alias("contiguous"))


def rolling_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty-frame windows, read every fifth frame while there is voice and at least ten frames."""
    w = by_session().rowsBetween(-39, 0)
    f = frames(spark, sf_dir).withColumns({"n": F.count(F.lit(1)).over(w), "mean_rms": F.avg("rms").over(w), "voiced": F.count_if("voice").over(w)})
    return f.where("voice and n >= 10 and sequence % 5 = 0").select("session_id", "sequence", F.round(F.col("mean_rms") + 1e-9, 6).alias("mean_rms"), "voiced")


def voice_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voiced runs after inner gaps of up to four frames are closed and runs under three dropped."""
    f = frames(spark, sf_dir).withColumn("r", run_id(F.col("voice")))
    ends = Window.partitionBy("session_id")
    f = f.withColumns({"size": F.count(F.lit(1)).over(Window.partitionBy("session_id", "r")), "last": F.max("r").over(ends)})
    closed = F.col("voice") | ((F.col("size") <= 4) & (F.col("r") > 1) & (F.col("r") < F.col("last")))
    g = f.withColumn("on", closed).withColumn("r2", run_id(F.col("on")))
    return g.where("on").groupBy("session_id", "r2").agg(F.min("sequence").alias("start"), F.max("sequence").alias("stop"), F.count(F.lit(1)).alias("frames")).where("frames >= 3").drop("r2")


def voice_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last voiced frame, three frames wider, within the session; and the voiced share."""
    f = frames(spark, sf_dir)
    a, b = F.min(F.when(F.col("voice"), F.col("sequence"))), F.max(F.when(F.col("voice"), F.col("sequence")))
    return f.groupBy("session_id").agg(F.greatest(F.lit(1), a - 3).alias("start"), F.least(F.max("sequence"), b + 3).alias("stop"), F.round(F.avg(F.col("voice").cast("double")), 6).alias("voice_ratio"))


def utterance_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances of a user: events no more than 30 minutes apart."""
    e = read_table(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    e = e.withColumn("new", F.when(F.col("t") - F.lag("t").over(w) <= 1_800_000_000, 0).otherwise(1))
    e = e.withColumn("utterance", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("user_id", "utterance").agg(F.count(F.lit(1)).alias("frames"), ((F.max("t") - F.min("t")) / 1_000_000).cast("long").alias("seconds"))


def error_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event on exactly the second bad frame in a row; good frames reset."""
    f = frames(spark, sf_dir).withColumn("bad", F.col("rms") < 0.05)
    f = f.withColumn("r", run_id(F.col("bad")))
    k = F.row_number().over(Window.partitionBy("session_id", "r").orderBy("sequence"))
    return f.where("bad").withColumn("k", k).where("k = 2").select("session_id", "sequence")


def sentence_unit_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unit whose [start, end) holds a position, else the last unit."""
    f = frames(spark, sf_dir).select("session_id", "sequence", ((F.col("sequence") * 40) % 2500).alias("at"))
    units = spark.createDataFrame([(0, 0, 400), (1, 400, 900), (2, 900, 1500), (3, 1500, 2000)], "unit int, start int, stop int")
    hit = f.join(F.broadcast(units), (F.col("at") >= F.col("start")) & (F.col("at") < F.col("stop")), "left")
    return hit.select("session_id", "sequence", "at", F.coalesce("unit", F.lit(3)).alias("unit"))


def linspace_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most twelve evenly spaced frames of each session, places cut to whole numbers."""
    f = frames(spark, sf_dir).withColumns({"i": F.col("sequence") - 1, "n": F.count(F.lit(1)).over(Window.partitionBy("session_id"))})
    take = F.least(F.col("n"), F.lit(12))
    picks = F.transform(F.sequence(F.lit(0), take.cast("int") - 1), lambda k: F.when(take > 1, F.floor(k * (F.col("n") - 1) / (take - 1))).otherwise(F.lit(0)))
    return f.where(F.array_contains(picks, F.col("i").cast("long"))).select("session_id", "sequence", "event_id")


def downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(F.aggregate(F.filter("embedding", lambda x, i: i % 2 == 0), F.lit(0.0), lambda s, x: s + x), 5).alias("even_sum"))


def preemphasis_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x[t] - 0.97 x[t-1], and the five-point slope with edges repeated."""
    f = frames(spark, sf_dir)
    first, last = F.first("rms").over(by_session().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.last("rms").over(by_session().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    x = F.col("rms")
    f = f.withColumns({"emphasised": x - 0.97 * F.coalesce(F.lag("rms").over(by_session()), F.lit(0.0)), "f": first, "l": last})
    ahead = lambda k: F.coalesce(F.lead("rms", k).over(by_session()), F.col("l"))
    behind = lambda k: F.coalesce(F.lag("rms", k).over(by_session()), F.col("f"))
    return f.select("session_id", "sequence", F.round("emphasised", 6).alias("emphasised"), F.round((ahead(1) - behind(1) + 2 * (ahead(2) - behind(2))) / 10, 6).alias("delta"))


def noise_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20th percentile of frame levels, the voice threshold above it, and the SNR of voiced over other frames."""
    f = staged(frames(spark, sf_dir).withColumn("db", 20 * F.log10(F.greatest("rms", F.lit(1e-8)))))
    f = f.join(exact_quantiles(f, "session_id", "db", {"floor": 0.2}), "session_id").withColumn("on", F.col("db") >= F.greatest(F.round(F.col("floor") + 9, 9), F.lit(-42.0)))
    off = exact_quantiles(f.where(~F.col("on")), "session_id", "rms", {"noise": 0.5})
    voice = F.sqrt(F.avg(F.when(F.col("on"), F.col("rms") * F.col("rms"))))
    g = f.groupBy("session_id").agg(F.max("floor").alias("floor"), F.count_if("on").alias("voiced"), voice.alias("voice")).join(off, "session_id", "left")
    least = F.lit(1e-8)
    snr = 20 * F.log10(F.greatest("voice", least) / F.greatest(F.coalesce("noise", least), least))
    return g.select("session_id", F.round("floor", 5).alias("floor_db"), "voiced", F.round(snr, 5).alias("snr_db"))


QUERIES = {f.__name__: f for f in (frame_contiguity, rolling_features, voice_segments, voice_trim, utterance_sessions, error_debounce, sentence_unit_range_join, linspace_sample, downsample, preemphasis_delta, noise_floor)}
_RUN = "sum(CASE WHEN {f} IS NOT DISTINCT FROM p THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY sequence ROWS UNBOUNDED PRECEDING)"
ORACLE_SQL = {
    "frame_contiguity": "SELECT conv_id, min(turn) AS first, count(*) AS n, max(turn) - min(turn) + 1 = count(*) AND count(DISTINCT turn) = count(*) AS contiguous FROM conversations GROUP BY 1",
    "rolling_features": FRAMES_SQL + ", w AS (SELECT *, count(*) OVER a AS n, avg(rms) OVER a AS m, count_if(voice) OVER a AS v FROM fr WINDOW a AS (PARTITION BY session_id ORDER BY sequence ROWS BETWEEN 39 PRECEDING AND CURRENT ROW)) SELECT session_id, sequence, round(m + 1e-9, 6) AS mean_rms, v AS voiced FROM w WHERE voice AND n >= 10 AND sequence % 5 = 0",
    "voice_segments": FRAMES_SQL + f""", a AS (SELECT *, lag(voice) OVER (PARTITION BY session_id ORDER BY sequence) AS p FROM fr), b AS (SELECT * EXCLUDE p, {_RUN.format(f='voice')} AS r FROM a),
      c AS (SELECT *, count(*) OVER (PARTITION BY session_id, r) AS z, max(r) OVER (PARTITION BY session_id) AS l FROM b), d AS (SELECT session_id, sequence, voice OR (z <= 4 AND r > 1 AND r < l) AS o FROM c),
      e AS (SELECT *, lag(o) OVER (PARTITION BY session_id ORDER BY sequence) AS p FROM d), g AS (SELECT session_id, sequence, o, {_RUN.format(f='o')} AS r FROM e)
      SELECT session_id, min(sequence) AS start, max(sequence) AS stop, count(*) AS frames FROM g WHERE o GROUP BY session_id, r HAVING count(*) >= 3""",
    "voice_trim": FRAMES_SQL + " SELECT session_id, greatest(1, min(CASE WHEN voice THEN sequence END) - 3) AS start, least(max(sequence), max(CASE WHEN voice THEN sequence END) + 3) AS stop, round(avg(voice::INT), 6) AS voice_ratio FROM fr GROUP BY 1",
    "utterance_sessions": "WITH a AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events), b AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) <= 1800000000 THEN 0 ELSE 1 END AS new FROM a), c AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS utterance FROM b) SELECT user_id, utterance, count(*) AS frames, (max(t) - min(t)) // 1000000 AS seconds FROM c GROUP BY 1, 2",
    "error_debounce": FRAMES_SQL + f", h AS (SELECT session_id, sequence, rms < 0.05 AS bad FROM fr), a AS (SELECT *, lag(bad) OVER (PARTITION BY session_id ORDER BY sequence) AS p FROM h), b AS (SELECT session_id, sequence, bad, {_RUN.format(f='bad')} AS r FROM a) SELECT session_id, sequence FROM b WHERE bad QUALIFY row_number() OVER (PARTITION BY session_id, r ORDER BY sequence) = 2",
    "sentence_unit_range_join": FRAMES_SQL + " SELECT session_id, sequence, (sequence * 40) % 2500 AS at, CASE WHEN (sequence * 40) % 2500 < 400 THEN 0 WHEN (sequence * 40) % 2500 < 900 THEN 1 WHEN (sequence * 40) % 2500 < 1500 THEN 2 ELSE 3 END AS unit FROM fr",
    "linspace_sample": FRAMES_SQL + ", n AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS n FROM fr) SELECT session_id, sequence, event_id FROM n WHERE sequence - 1 IN (SELECT CASE WHEN least(n.n, 12) > 1 THEN floor(k * (n.n - 1) / (least(n.n, 12) - 1))::BIGINT ELSE 0 END FROM range(12) t(k) WHERE k < least(n.n, 12))",
    "downsample": "SELECT vec_id, round(list_sum(list_transform(embedding[1:64:2], lambda x: x::DOUBLE)), 5) AS even_sum FROM embeddings",
    "preemphasis_delta": FRAMES_SQL + ", d AS (SELECT *, lag(rms, 1) OVER w AS b1, lag(rms, 2) OVER w AS b2, lead(rms, 1) OVER w AS a1, lead(rms, 2) OVER w AS a2, first_value(rms) OVER (PARTITION BY session_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f, last_value(rms) OVER (PARTITION BY session_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM fr WINDOW w AS (PARTITION BY session_id ORDER BY sequence)) SELECT session_id, sequence, round(rms - 0.97 * coalesce(b1, 0), 6) AS emphasised, round((coalesce(a1, l) - coalesce(b1, f) + 2 * (coalesce(a2, l) - coalesce(b2, f))) / 10, 6) AS delta FROM d",
    "noise_floor": FRAMES_SQL + ", l AS (SELECT *, 20 * log10(greatest(rms, 1e-8)) AS db FROM fr), f AS (SELECT session_id, quantile_cont(db, 0.2) AS fl FROM l GROUP BY 1), o AS (SELECT l.*, fl, db >= greatest(round(fl + 9, 9), -42.0) AS o FROM l JOIN f USING (session_id)) SELECT session_id, round(max(fl), 5) AS floor_db, count_if(o) AS voiced, round(20 * log10(greatest(sqrt(avg(CASE WHEN o THEN rms * rms END)), 1e-8) / greatest(coalesce(quantile_cont(CASE WHEN NOT o THEN rms END, 0.5), 1e-8), 1e-8)), 5) AS snr_db FROM o GROUP BY 1",
}
