"""Ingest gates, deduplication, upserts, consent and review joins, counters and JSON edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echolark.core import read_table
from echolark.functions.hashing import variant
from echolark.plans.domain import LOGS_SQL, REC_SQL, decision_logs, recordings


def speaker_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and speakers of each split, and speakers that sit in more than one."""
    recs = recordings(spark, sf_dir)
    leaked = recs.groupBy("speaker_hash").agg(F.countDistinct("split").alias("k")).where("k > 1").agg(F.count(F.lit(1)).alias("leaked"))
    return recs.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("speaker_hash").alias("speakers")).crossJoin(F.broadcast(leaked))


def ingest_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings of a recording by duration, level and clipping; accepted without any."""
    e = read_table(spark, sf_dir, "events").select("event_id", (F.col("value") / 40).alias("duration_s"), (20 * F.log10(F.greatest(F.col("value") / 500, F.lit(1e-9)))).alias("dbfs"), ((F.col("event_id") % 100) / 50000.0).alias("clipped"))
    warnings = F.array_compact(F.array(F.when(F.col("duration_s") < 0.3, "too_short"), F.when(F.col("duration_s") > 2.0, "too_long"), F.when(F.col("dbfs") < -45, "too_quiet"), F.when(F.col("clipped") > 0.001, "clipped")))
    return e.select("event_id", F.array_join(warnings, ",").alias("warnings"), F.when(F.size(warnings) == 0, "ACCEPT").when(F.array_contains(warnings, "too_short"), "RETRY").otherwise("REJECT").alias("status"))


def _first_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("word"), F.sha2("text", 256).alias("source_hash"))
    first = d.groupBy("source_hash").agg(F.min(F.struct("doc_id", "word")).alias("f"))
    return first.select("source_hash", "f.doc_id", "f.word")


def dedupe_limit_per_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three different recordings of each word; duplicates go before the limit."""
    order = F.row_number().over(Window.partitionBy("word").orderBy("doc_id"))
    return _first_copies(spark, sf_dir).withColumn("ordinal", order).where("ordinal <= 3")


def import_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").select(F.col("lang").alias("word"), F.sha2("text", 256).alias("h"), F.col("n_chars"))
    per = d.groupBy("word", "h").agg(F.count(F.lit(1)).alias("n"), F.max("n_chars").alias("n_chars"))
    return per.groupBy("word").agg(F.sum("n").alias("seen"), F.count(F.lit(1)).alias("stored"), (F.sum("n") - F.count(F.lit(1))).alias("duplicates"), F.count_if(F.col("n_chars").between(200, 5000)).alias("accepted"), F.count_if(F.col("n_chars") > 5000).alias("rejected"), F.count_if(F.col("n_chars") < 200).alias("retry"))


def latest_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest version of each brand and size, versions ordered as text."""
    p = read_table(spark, sf_dir, "part")
    rk = F.row_number().over(Window.partitionBy("p_brand", "p_size").orderBy(F.desc("p_name"), F.desc("p_partkey")))
    return p.withColumn("rk", rk).where("rk = 1").select("p_brand", "p_size", "p_partkey", "p_name")


def upsert_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even parts as stored rows, all parts of size 10 and less as a rebuild: same key keeps its id, siblings go inactive."""
    p = read_table(spark, sf_dir, "part")
    stored = p.where("p_partkey % 2 = 0").select("p_brand", "p_size", F.col("p_partkey").alias("old_id"), F.col("p_retailprice").alias("old_price"))
    stored = stored.groupBy("p_brand", "p_size").agg(F.min(F.struct("old_id", "old_price")).alias("o"))
    new = p.where("p_size <= 10").groupBy("p_brand", "p_size").agg(F.max(F.struct("p_partkey", "p_retailprice")).alias("n"))
    j = stored.join(new, ["p_brand", "p_size"], "full")
    return j.select("p_brand", "p_size", F.coalesce("o.old_id", "n.p_partkey").alias("id"), F.coalesce("n.p_retailprice", "o.old_price").alias("price"), F.col("n").isNotNull().alias("active"))


def insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose hash no earlier source has stored, once each."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    stored = d.where("source <= 'src15'").select("h").distinct()
    return d.where("source > 'src15'").join(stored, "h", "left_anti").groupBy("h").agg(F.min("doc_id").alias("doc_id"))


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 oldest logs without a ground truth."""
    logs = decision_logs(spark, sf_dir).where("status in ('REVIEW_REQUIRED', 'UNDECIDABLE')")
    return logs.orderBy("ts", "attempt_id").limit(50).select("attempt_id", "session_id", "status")


def consent_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active sessions of clients whose consent is granted."""
    c = read_table(spark, sf_dir, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("client_id"), F.concat(F.lit("age"), (F.col("c_nationkey") % 4).cast("string")).alias("age_band"))
    o = read_table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("client_id"), F.col("o_orderkey").alias("session_id"))
    return o.join(c, "client_id")


#: Rows that a task sorts, on average, so that more input makes more tasks and not larger ones.
TASK_ROWS = 250_000


def repetition_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetitions numbered within sessions, with verdicts; sessions must exist. Rows are dealt by session once, over
    tasks of bounded size, for the join, the order and the counts."""
    li = read_table(spark, sf_dir, "lineitem")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-li.count() // TASK_ROWS))
    li = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag").repartition(parts, "l_orderkey")
    li = li.join(read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    verdict = F.when(F.col("l_returnflag") == "A", "accepted").when(F.col("l_returnflag") == "N", "retry").otherwise("speech_error")
    return li.select("l_orderkey", "l_partkey", F.row_number().over(order).alias("repetition_index"), verdict.alias("verdict")).groupBy("l_orderkey", "verdict").agg(F.count(F.lit(1)).alias("n"), F.min("repetition_index").alias("first_index"))


def annotate_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs with the latest annotation, if any."""
    logs = decision_logs(spark, sf_dir)
    notes = read_table(spark, sf_dir, "events").where("event_id % 3 = 0").select((F.col("event_id") / 3).cast("long").alias("attempt_id"), F.col("event_id").alias("note_id"), F.col("event_type").alias("truth"))
    last = notes.groupBy("attempt_id").agg(F.max(F.struct("note_id", "truth")).alias("a"))
    return logs.join(last, "attempt_id", "left").select("attempt_id", "status", F.col("a.truth").alias("truth"))


def status_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision_logs(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("decisions"), F.countDistinct("session_id").alias("sessions"))


BUCKETS = [10.0, 25.0, 50.0, 100.0, 250.0]


def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative buckets as exposition lines."""
    logs = decision_logs(spark, sf_dir)
    sums = logs.groupBy("status").agg(*[F.count_if(F.col("latency") <= b).alias(f"{b:g}") for b in BUCKETS], F.count("latency").alias("+Inf"))
    long = sums.selectExpr("status", f"stack({len(BUCKETS) + 1}, " + ", ".join(f"'{b:g}', `{b:g}`" for b in BUCKETS) + ", '+Inf', `+Inf`) as (le, n)")
    return long.select("status", "le", "n", F.format_string('latency_bucket{status="%s",le="%s"} %d', "status", "le", "n").alias("line"))


def nearest_rank_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value at index round(0.95 (n - 1)) of each session, halves to even."""
    logs = decision_logs(spark, sf_dir)
    w = Window.partitionBy("session_id")
    r = logs.withColumn("i", F.row_number().over(w.orderBy("latency", "attempt_id")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    return r.where(F.col("i") == F.bround(F.lit(0.95) * (F.col("n") - 1), 0).cast("int")).select("session_id", F.col("latency").alias("p95"))


def token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words in first-seen order, those a required list lacks, and whether all are there."""
    t = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z']+"), F.lit(0))).alias("words"))
    required = F.array(F.lit("the"), F.lit("of"), F.lit("and"))
    missing = F.array_except(required, F.col("words"))
    return t.select("conv_id", "turn", F.size("words").cast("long").alias("n_words"), F.array_join(missing, " ").alias("missing"), (F.size(missing) == 0).alias("complete"))


def ab_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    return c.select("c_custkey", variant(F.concat(F.lit("exp:"), F.col("c_custkey").cast("string")), 20.0).alias("variant"))


def signals_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A numeric signal from JSON with a default, and the log as canonical JSON."""
    logs = decision_logs(spark, sf_dir)
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast("double"), F.lit(0.0))
    return logs.select("attempt_id", k.alias("k"), F.to_json(F.struct("attempt_id", "session_id", "status")).alias("document"))


def ui_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flat event: score from the clamped latency or the status, with a confidence fallback."""
    logs = decision_logs(spark, sf_dir)
    score = F.when(F.col("latency") < 100, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("latency") / 50))).when(F.col("status") == "CORRECT", 1.0).when(F.col("status") == "INCORRECT", 0.0)
    return logs.select("attempt_id", F.bround(score, 4).alias("score"), F.coalesce(F.bround(F.abs(score - 0.5) * 2, 4), F.lit(0.0)).alias("confidence"), F.lower("status").alias("event"))


def id_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.translate("c_name", "#", "-").alias("identifier"), F.translate("c_name", "#", "-").rlike(r"^[A-Za-z0-9][A-Za-z0-9_-]{0,127}$").alias("valid"))


def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match rate of a rule on text length with labelled quality, by language, joined once."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    j = d.join(read_table(spark, sf_dir, "labels"), "doc_id")
    rule = F.when(F.col("n_chars") >= 300, 1).otherwise(0)
    return j.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((rule == F.col("quality")).cast("double")), 6).alias("accuracy"))


QUERIES = {f.__name__: f for f in (speaker_split, ingest_quality, dedupe_limit_per_word, import_summary, latest_active, upsert_benchmark, insert_or_ignore, review_queue, consent_join, repetition_reviews, annotate_decisions, status_counters, latency_histogram, nearest_rank_p95, token_sets, ab_assignment, signals_json, ui_event, id_regex, accuracy)}
_FIRST = "WITH f AS (SELECT sha256(text) AS source_hash, min(struct_pack(d := doc_id, w := lang)) AS m FROM documents GROUP BY 1), g AS (SELECT source_hash, m.d AS doc_id, m.w AS word FROM f) "
ORACLE_SQL = {
    "speaker_split": REC_SQL + ", k AS (SELECT count(*) AS leaked FROM (SELECT speaker_hash FROM spl GROUP BY 1 HAVING count(DISTINCT split) > 1)) SELECT split, count(*) AS n, count(DISTINCT speaker_hash) AS speakers, max(leaked) AS leaked FROM spl, k GROUP BY split",
    "ingest_quality": """WITH e AS (SELECT event_id, value / 40 AS s, 20 * log10(greatest(value / 500, 1e-9)) AS db, (event_id % 100) / 50000.0::DOUBLE AS c FROM events),
      w AS (SELECT event_id, list_filter([CASE WHEN s < 0.3 THEN 'too_short' END, CASE WHEN s > 2.0 THEN 'too_long' END, CASE WHEN db < -45 THEN 'too_quiet' END, CASE WHEN c > 0.001 THEN 'clipped' END], lambda x: x IS NOT NULL) AS l FROM e)
      SELECT event_id, array_to_string(l, ',') AS warnings, CASE WHEN len(l) = 0 THEN 'ACCEPT' WHEN list_contains(l, 'too_short') THEN 'RETRY' ELSE 'REJECT' END AS status FROM w""",
    "dedupe_limit_per_word": _FIRST + "SELECT *, row_number() OVER (PARTITION BY word ORDER BY doc_id) AS ordinal FROM g QUALIFY ordinal <= 3",
    "import_summary": "WITH p AS (SELECT lang AS word, sha256(text) AS h, count(*) AS n, max(n_chars) AS c FROM documents GROUP BY 1, 2) SELECT word, CAST(sum(n) AS BIGINT) AS seen, count(*) AS stored, CAST(sum(n) - count(*) AS BIGINT) AS duplicates, count_if(c BETWEEN 200 AND 5000) AS accepted, count_if(c > 5000) AS rejected, count_if(c < 200) AS retry FROM p GROUP BY 1",
    "latest_active": "SELECT p_brand, p_size, p_partkey, p_name FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_name DESC, p_partkey DESC) = 1",
    "upsert_benchmark": """WITH s AS (SELECT p_brand, p_size, min(p_partkey) AS i, arg_min(p_retailprice, p_partkey) AS p FROM part WHERE p_partkey % 2 = 0 GROUP BY 1, 2),
      n AS (SELECT p_brand, p_size, max(p_partkey) AS i, arg_max(p_retailprice, p_partkey) AS p FROM part WHERE p_size <= 10 GROUP BY 1, 2)
      SELECT coalesce(s.p_brand, n.p_brand) AS p_brand, coalesce(s.p_size, n.p_size) AS p_size, coalesce(s.i, n.i) AS id, coalesce(n.p, s.p) AS price, n.i IS NOT NULL AS active FROM s FULL JOIN n ON s.p_brand = n.p_brand AND s.p_size = n.p_size""",
    "insert_or_ignore": "WITH d AS (SELECT doc_id, source, sha256(text) AS h FROM documents) SELECT h, min(doc_id) AS doc_id FROM d WHERE source > 'src15' AND h NOT IN (SELECT h FROM d WHERE source <= 'src15') GROUP BY h",
    "review_queue": LOGS_SQL + " SELECT attempt_id, session_id, status FROM lg WHERE status IN ('REVIEW_REQUIRED', 'UNDECIDABLE') ORDER BY ts, attempt_id LIMIT 50",
    "consent_join": "SELECT c_custkey AS client_id, o_orderkey AS session_id, 'age' || (c_nationkey % 4) AS age_band FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' AND c_acctbal >= 0",
    "repetition_reviews": """WITH r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS i, CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'N' THEN 'retry' ELSE 'speech_error' END AS verdict
      FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)) SELECT l_orderkey, verdict, count(*) AS n, min(i) AS first_index FROM r GROUP BY 1, 2""",
    "annotate_decisions": LOGS_SQL + ", a AS (SELECT CAST(event_id / 3 AS BIGINT) AS attempt_id, event_type AS truth FROM events WHERE event_id % 3 = 0) SELECT attempt_id, status, truth FROM lg LEFT JOIN a USING (attempt_id)",
    "status_counters": LOGS_SQL + " SELECT status, count(*) AS decisions, count(DISTINCT session_id) AS sessions FROM lg GROUP BY 1",
    "latency_histogram": LOGS_SQL + """, b(le, v) AS (VALUES ('10', 10.0), ('25', 25.0), ('50', 50.0), ('100', 100.0), ('250', 250.0), ('+Inf', 1e300)),
      c AS (SELECT status, le, count_if(latency <= v) AS n FROM lg, b GROUP BY 1, 2) SELECT status, le, n, 'latency_bucket{status="' || status || '",le="' || le || '"} ' || n AS line FROM c""",
    "nearest_rank_p95": LOGS_SQL + ", r AS (SELECT session_id, latency, row_number() OVER (PARTITION BY session_id ORDER BY latency, attempt_id) - 1 AS i, count(*) OVER (PARTITION BY session_id) AS n FROM lg) SELECT session_id, latency AS p95 FROM r WHERE i = round_even(0.95 * (n - 1), 0)",
    "token_sets": """WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z'']+')) AS w FROM conversations),
      m AS (SELECT conv_id, turn, CAST(len(w) AS BIGINT) AS n_words, list_filter(['the', 'of', 'and'], lambda x: NOT list_contains(w, x)) AS l FROM t)
      SELECT conv_id, turn, n_words, array_to_string(l, ' ') AS missing, len(l) = 0 AS complete FROM m""",
    "ab_assignment": "SELECT c_custkey, CASE WHEN ('0x' || substr(sha256('exp:' || c_custkey), 1, 16))::UBIGINT % 10000 < 2000 THEN 'candidate' ELSE 'control' END AS variant FROM customer",
    "signals_json": LOGS_SQL + """ SELECT attempt_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0.0) AS k, '{"attempt_id":' || attempt_id || ',"session_id":' || session_id || ',"status":"' || status || '"}' AS document FROM lg""",
    "ui_event": LOGS_SQL + ", s AS (SELECT attempt_id, status, CASE WHEN latency < 100 THEN greatest(0.0, least(1.0, latency / 50)) WHEN status = 'CORRECT' THEN 1.0 WHEN status = 'INCORRECT' THEN 0.0 END AS v FROM lg) SELECT attempt_id, round_even(v, 4) AS score, coalesce(round_even(abs(v - 0.5) * 2, 4), 0.0) AS confidence, lower(status) AS event FROM s",
    "id_regex": "SELECT c_custkey, replace(c_name, '#', '-') AS identifier, regexp_matches(replace(c_name, '#', '-'), '^[A-Za-z0-9][A-Za-z0-9_-]{0,127}$') AS valid FROM customer",
    "accuracy": "SELECT lang, count(*) AS n, round(avg(CAST((CASE WHEN n_chars >= 300 THEN 1 ELSE 0 END) = quality AS INT)), 6) AS accuracy FROM documents JOIN labels USING (doc_id) GROUP BY 1",
}
