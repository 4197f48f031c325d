"""Parsing of frames, windows and training lines, and sinks: upserts, appends with ids, audit rows and reports.

Tables are written by Spark to the shared folder and read back. An upsert joins what is stored with what
comes; a row's id is a hash of its key, so that a job that runs again gives the same ids.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echolark.core import read_table, shared_dir, staged
from echolark.plans.domain import LOGS_SQL, decision_logs

FRAME_BYTES, RATE, FRAME_MS = 1_280, 16_000, 40
REQUIRED = ("sequence", "captured_at_ns", "sample_rate", "frame_ms", "pcm")


def _raw_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw records of an audio stream: text fields, some missing or wrong."""
    e = read_table(spark, sf_dir, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    bad = F.col("event_id") % 50
    pcm = F.rpad(F.sha2(F.col("event_id").cast("string"), 256), F.when(bad == 1, 1_000).otherwise(FRAME_BYTES).cast("int"), F.lit("0"))
    pairs = {"sequence": F.when(bad == 2, "x").otherwise(n.cast("string")), "captured_at_ns": F.when(bad != 3, (n.cast("long") * 40_000_000).cast("string")), "sample_rate": F.when(bad == 4, "8000").otherwise("16000"), "frame_ms": F.when(bad == 5, "20").otherwise("40"), "pcm": pcm}
    fields = F.map_filter(F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    return e.select(F.col("user_id").alias("session_id"), "event_id", fields.alias("fields"))


def parsed_frames(raw: DataFrame) -> DataFrame:
    """raw (.., fields) with sequence and pcm, and what is wrong with a record, if anything: missing
    fields, then rate, then duration, then size, then a sequence that is no number."""
    of = lambda k: F.try_element_at("fields", F.lit(k))
    missing = F.array_except(F.array(*map(F.lit, REQUIRED)), F.map_keys("fields"))
    fault = F.when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(F.sort_array(missing), ", ")))
    for test, name in ((~of("sample_rate").try_cast("int").eqNullSafe(F.lit(RATE)), "rate"), (~of("frame_ms").try_cast("int").eqNullSafe(F.lit(FRAME_MS)), "duration"), (F.octet_length(of("pcm")) != FRAME_BYTES, "size"), (of("sequence").try_cast("int").isNull(), "sequence")):
        fault = fault.when(test, F.lit(name))
    return raw.withColumns({"fault": fault, "sequence": of("sequence").try_cast("int"), "pcm": of("pcm").cast("binary")}).drop("fields")


def frame_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record's sequence, and its fault; records with one go to quarantine."""
    p = parsed_frames(_raw_frames(spark, sf_dir))
    return p.select("event_id", F.when(F.col("fault").isNull(), F.col("sequence")).alias("sequence"), "fault")


def assemble_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of eight frames of a session, their payloads joined in order; windows with a gap are not
    contiguous and have no payload."""
    p = parsed_frames(_raw_frames(spark, sf_dir)).where("fault is null").withColumn("window", F.floor((F.col("sequence") - 1) / 8))
    g = p.groupBy("session_id", "window").agg(F.sort_array(F.collect_list(F.struct("sequence", "pcm"))).alias("held"), F.min("sequence").alias("first"), F.max("sequence").alias("last"), F.count(F.lit(1)).alias("frames"))
    whole = F.aggregate("held", F.lit("").cast("binary"), lambda s, x: F.concat(s, x.pcm))
    fine = F.col("last") - F.col("first") + 1 == F.col("frames")
    return g.select("session_id", "window", "frames", fine.alias("contiguous"), F.when(fine, F.sha2(whole, 256)).alias("payload_sha256"))


def pcm_frames(audio: DataFrame, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """(key, frame, pcm) of audio (key, pcm): whole frames only, a rest is dropped."""
    n = F.floor(F.octet_length("pcm") / frame_bytes).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return audio.select("key", "pcm", F.explode(at).alias("frame")).select("key", "frame", F.substring("pcm", F.col("frame") * frame_bytes + 1, F.lit(frame_bytes)).alias("pcm"))


def pcm_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of every text's bytes taken as samples."""
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("text").cast("binary").alias("pcm"))
    return pcm_frames(d).select("key", "frame", F.sha2("pcm", 256).alias("frame_sha256"))


def training_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples written as JSON lines with blank lines between, and read by schema; blank lines give none."""
    j = read_table(spark, sf_dir, "documents").join(read_table(spark, sf_dir, "labels"), "doc_id")
    line = F.to_json(F.struct("doc_id", "lang", F.array(F.col("n_chars").cast("double"), F.col("quality").cast("double")).alias("features"), F.col("toxic").cast("boolean").alias("label")))
    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    j.select(F.explode(F.array(line, F.lit(""))).alias("value")).write.text(path)
    return spark.read.schema("doc_id long, lang string, features array<double>, label boolean").json(path).select("doc_id", "lang", F.col("features")[0].alias("f0"), F.col("features")[1].alias("f1"), "label")


def upserted(stored: DataFrame, new: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """stored with the rows of new: of one key the row of the greatest `order` stays, new before stored."""
    both = stored.withColumn("is_new", F.lit(0)).unionByName(new.withColumn("is_new", F.lit(1)))
    rest = [c for c in stored.columns if c not in key]
    last = both.groupBy(*key).agg(F.max(F.struct(order, "is_new", *[c for c in rest if c != order])).alias("last"))
    return last.select(*key, *[F.col(f"last.{c}").alias(c) for c in rest])


def upsert_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of sessions, stored from earlier events, upserted with those of later ones."""
    e = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), "event_type", F.col("event_id").alias("version"), "value")
    stored = staged(e.where("version % 2 = 0").groupBy("session_id", "event_type").agg(F.max(F.struct("version", "value")).alias("m")).select("session_id", "event_type", "m.version", "m.value"))
    new = e.where("version % 2 = 1").groupBy("session_id", "event_type").agg(F.max(F.struct("version", "value")).alias("m")).select("session_id", "event_type", "m.version", "m.value")
    return staged(upserted(stored, new, ["session_id", "event_type"], "version"))


def attempt_id(*key: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *key), 256), 1, 32)


def append_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts appended in two runs to one table; each gets an id from its key, which is returned."""
    logs = decision_logs(spark, sf_dir)
    path = f"{shared_dir(spark)}/attempts-{uuid.uuid4().hex}"
    rows = logs.select(attempt_id(F.col("session_id").cast("string"), F.col("attempt_id").cast("string")).alias("id"), "attempt_id", "session_id", "status")
    for half in (0, 1):
        rows.where(F.col("attempt_id") % 2 == half).write.mode("append").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit row for each write of a clinical flow, appended with what it tells about; by action, how
    many rows and actors there are and when the first and last came."""
    o = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entity"), F.col("o_custkey").alias("actor"), F.col("o_orderdate").alias("at"), "o_orderstatus")
    steps = [("session.created", F.lit(True)), ("session.closed", F.col("o_orderstatus") == "F"), ("review.added", F.col("entity") % 4 == 0)]
    path = f"{shared_dir(spark)}/audit-{uuid.uuid4().hex}"
    for action, test in steps:
        o.where(test).select(F.lit(action).alias("action"), "entity", "actor", "at").write.mode("append").parquet(path)
    rows = spark.read.schema("action string, entity long, actor long, at timestamp_ntz").parquet(path)
    return rows.groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("actor").alias("actors"), F.min("at").alias("first"), F.max("at").alias("last"))


def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of each session as a JSON document with sorted keys, written and read back."""
    logs = decision_logs(spark, sf_dir)
    g = logs.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "CORRECT").alias("correct"), F.round(F.max("latency"), 3).alias("slowest"))
    path = f"{shared_dir(spark)}/reports-{uuid.uuid4().hex}"
    g.select(F.struct(*[F.col(c) for c in sorted(g.columns)]).alias("r")).select("r.*").write.json(path)
    return spark.read.schema("correct long, n long, session_id long, slowest double").json(path)


def conjunction(filters: dict[str, object]) -> Column:
    """All of the given filters that are not null, as one condition; none of them is true."""
    return reduce(lambda a, b: a & b, [F.col(k) == v for k, v in filters.items() if v is not None], F.lit(True))


def list_benchmarks(spark: SparkSession, sf_dir: str, brand: str | None = None, size: int | None = 10) -> DataFrame:
    """The active benchmarks that the given filters leave, newest id first within a word."""
    p = read_table(spark, sf_dir, "part").where(conjunction({"p_brand": brand, "p_size": size}))
    top = p.groupBy("p_brand", "p_size").agg(F.max("p_partkey").alias("id"), F.count(F.lit(1)).alias("versions"))
    return top.select(F.col("p_brand").alias("word"), "p_size", "id", "versions")


def target_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The active benchmark of each attempt's word; words without one are LOOKUP_ERROR. Benchmarks are
    one row a word and size."""
    b = staged(list_benchmarks(spark, sf_dir, size=None).where("p_size <= 20").groupBy("word").agg(F.max("id").alias("id")))
    li = read_table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("attempts"))
    words = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_partkey") % 7 == 0, F.lit("none")).otherwise(F.col("p_brand")).alias("word"))
    by_word = li.join(words, "l_partkey").groupBy("word").agg(F.sum("attempts").alias("attempts"))
    return by_word.join(b, "word", "left").select("word", "attempts", "id", F.when(F.col("id").isNull(), "LOOKUP_ERROR").otherwise("FOUND").alias("status"))


def public_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs without what stays inside: raw properties, latency, session and time."""
    return decision_logs(spark, sf_dir).drop("props", "latency", "session_id", "ts")


QUERIES = {f.__name__: f for f in (frame_parse, assemble_window, pcm_split, training_lines, upsert_features, append_attempts, audit_log, json_report, list_benchmarks, target_lookup, public_payload)}
_RAW = """WITH r AS (SELECT event_id, user_id AS session_id, event_id % 50 AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  p AS (SELECT *, CASE bad WHEN 3 THEN 'missing: captured_at_ns' WHEN 4 THEN 'rate' WHEN 5 THEN 'duration' WHEN 1 THEN 'size' WHEN 2 THEN 'sequence' END AS fault, rpad(sha256(CAST(event_id AS VARCHAR)), 1280, '0') AS pcm FROM r) """
ORACLE_SQL = {
    "frame_parse": _RAW + "SELECT event_id, CASE WHEN fault IS NULL THEN CAST(n AS INT) END AS sequence, fault FROM p",
    "assemble_window": _RAW + ", g AS (SELECT session_id, (n - 1) // 8 AS \"window\", count(*) AS frames, max(n) - min(n) + 1 = count(*) AS contiguous, string_agg(pcm, '' ORDER BY n) AS whole FROM p WHERE fault IS NULL GROUP BY 1, 2) SELECT session_id, \"window\", frames, contiguous, CASE WHEN contiguous THEN sha256(whole) END AS payload_sha256 FROM g",
    "pcm_split": "WITH d AS (SELECT doc_id AS key, encode(text) AS b, unnest(range(octet_length(encode(text)) // 1280)) AS k FROM documents) SELECT key, CAST(k AS INT) AS frame, sha256(b[k * 1280 + 1:(k + 1) * 1280]) AS frame_sha256 FROM d",
    "training_lines": "SELECT doc_id, lang, CAST(n_chars AS DOUBLE) AS f0, CAST(quality AS DOUBLE) AS f1, toxic = 1 AS label FROM documents JOIN labels USING (doc_id)",
    "upsert_features": "SELECT user_id AS session_id, event_type, max(event_id) AS version, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2",
    "append_attempts": LOGS_SQL + " SELECT substr(sha256(session_id || '|' || attempt_id), 1, 32) AS id, attempt_id, session_id, status FROM lg",
    "audit_log": """WITH a AS (SELECT 'session.created' AS action, o_custkey, o_orderdate FROM orders UNION ALL SELECT 'session.closed', o_custkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'review.added', o_custkey, o_orderdate FROM orders WHERE o_orderkey % 4 = 0)
      SELECT action, count(*) AS n, count(DISTINCT o_custkey) AS actors, min(o_orderdate) AS first, max(o_orderdate) AS last FROM a GROUP BY 1""",
    "json_report": LOGS_SQL + " SELECT session_id, count(*) AS n, count_if(status = 'CORRECT') AS correct, round(max(latency), 3) AS slowest FROM lg GROUP BY 1",
    "list_benchmarks": "SELECT p_brand AS word, p_size, max(p_partkey) AS id, count(*) AS versions FROM part WHERE p_size = 10 GROUP BY 1, 2",
    "target_lookup": """WITH b AS (SELECT p_brand AS word, max(p_partkey) AS id FROM part WHERE p_size <= 20 GROUP BY 1), w AS (SELECT CASE WHEN p_partkey % 7 = 0 THEN 'none' ELSE p_brand END AS word, count(*) AS attempts FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)
      SELECT word, attempts, id, CASE WHEN id IS NULL THEN 'LOOKUP_ERROR' ELSE 'FOUND' END AS status FROM w LEFT JOIN b USING (word)""",
    "public_payload": LOGS_SQL + " SELECT attempt_id, status FROM lg",
}
