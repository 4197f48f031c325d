"""Phones from alignment to verdict: alignment, lexicon, thresholds by phone, the decision cascade, slices and features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echolark.core import broadcast_if_small, read_table, staged
from echolark.functions.signal import ctc_phones
from echolark.operators.calibration import FAIL, LEAST_CONFIDENCE, PASS

#: Words and their phones, one reading a row.
LEXICON = """
bird b ɜː d
bird b ɝ d
follow f ɑː l oʊ
follow f ɒ l oʊ
forward f ɔːɹ w ɚ d
happy h æ p i
learn l ɜː n
learn l ɝ n
a ə
can k æ n
fly f l aɪ
the ð ə
little l ɪ t əl
take t eɪ k
one w ʌ n
step s t ɛ p
we w iː
new n uː
word w ɜː d
"""
LABELS, FRAMES, STRIDE_MS, DURATION_WEIGHT = 4, 16, 20.0, 0.1


def lexicon(spark: SparkSession) -> DataFrame:
    """(word, reading, phones) of the built-in lexicon, words in lower case."""
    rows, seen = [], {}
    for line in LEXICON.split("\n"):
        if line:
            word, *phones = line.split(" ")
            seen[word] = seen.get(word, -1) + 1
            rows.append((word, seen[word], phones))
    return spark.createDataFrame(rows, "word string, reading int, phones array<string>")


def lexicon_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of conversations with their readings and the phones of the first; a word that the lexicon
    lacks is UNDECIDABLE, not an error. Words are counted before they are looked up."""
    t = read_table(spark, sf_dir, "conversations").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z']+"), F.lit(0))).alias("word"))
    counts = t.groupBy(F.lower(F.trim("word")).alias("word")).agg(F.count(F.lit(1)).alias("n"))
    entries = lexicon(spark).groupBy("word").agg(F.count(F.lit(1)).alias("readings"), F.min(F.struct("reading", "phones")).alias("first"))
    found = counts.join(F.broadcast(entries), "word", "left")
    return found.select("word", "n", F.coalesce("readings", F.lit(0).cast("long")).alias("readings"), F.array_join("first.phones", " ").alias("phones"), F.when(F.col("first").isNull(), "UNDECIDABLE").otherwise("FOUND").alias("status"))


ALIGNED = "recording_id long, position int, expected int, observed int, start_ms int, end_ms int, p_expected double, p_other double, confidence double, status string, odd_duration boolean"


def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(recording_id, labels, evidence as FRAMES rows of LABELS scores) to the phones of each recording.
    Recordings without an alignment give no row."""
    names = [c.split()[0] for c in ALIGNED.split(", ")]
    kinds = [pa.int64(), *[pa.int32()] * 5, *[pa.float64()] * 3, pa.string(), pa.bool_()]
    for batch in batches:
        rows = []
        for key, labels, scores in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x = np.asarray(scores, float).reshape(-1, LABELS)
            x = 4 * x - np.log(np.exp(4 * x).sum(axis=1, keepdims=True))
            if len(x) >= len(labels):
                rows += [(key, k, *phone.values()) for k, phone in enumerate(ctc_phones(x, labels, 0, STRIDE_MS))]
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=names)


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as evidence of FRAMES frames over blank and three phones, aligned with three phones
    that the label spells."""
    e = read_table(spark, sf_dir, "embeddings").where(F.size("embedding") == FRAMES * LABELS)
    digit = lambda c: (F.pmod(c, F.lit(3)) + 1).cast("int")
    labels = F.array(digit(F.col("label")), digit(F.floor(F.col("label") / 3)), digit(F.col("label") + 1))
    return e.select(F.col("vec_id").alias("recording_id"), labels.alias("labels"), "embedding").mapInArrow(aligned, ALIGNED)


def ctc_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phones of every recording, by start, expected ones before insertions."""
    return alignments(spark, sf_dir)


def margins_of(phone: Column, fail: Column, passed: Column) -> tuple[Column, Column]:
    """The margins of a phone, or the usual ones; margins out of order are an error."""
    low, high = F.coalesce(fail, F.lit(FAIL)), F.coalesce(passed, F.lit(PASS))
    right = low < high
    return F.when(right, low).otherwise(F.raise_error(F.concat(F.lit("fail margin not below pass margin: "), phone.cast("string"))).cast("double")), high


def scored_phones(phones: DataFrame, thresholds: DataFrame) -> DataFrame:
    """phones (phone, p_expected, p_other, confidence, duration_ms, kind) with score and status.

    thresholds (phone, fail, pass, usual_ms) may lack any of them. Insertions and deletions fail with
    -20; else the log odds, less a penalty for an odd duration where a usual one is known, decide
    between the phone's margins, unless the alignment itself is not to be trusted."""
    own = broadcast_if_small(thresholds.select(F.col("phone").alias("of"), "fail", "pass", "usual_ms"))
    j = phones.join(own, F.col("of") == F.col("phone"), "left").drop("of")
    log = lambda c: F.ln(F.greatest(F.col(c), F.lit(1e-9)))
    odd = F.abs(F.ln(F.greatest(F.col("duration_ms"), F.lit(1)) / F.col("usual_ms")))
    margin = log("p_expected") - log("p_other") - DURATION_WEIGHT * F.coalesce(odd, F.lit(0.0))
    lost = F.col("kind").isin("INSERTION", "DELETION")
    low, high = margins_of(F.col("phone"), F.col("fail"), F.col("pass"))
    j = j.withColumn("score", F.when(lost, -20.0).otherwise(F.round(margin, 6)))
    status = F.when(lost, "FAIL").when(F.col("confidence") < LEAST_CONFIDENCE, "NOT_SCORABLE").when(margin <= low, "FAIL").when(margin >= high, "PASS").otherwise("BORDERLINE")
    return j.withColumn("verdict", status).drop("fail", "pass", "usual_ms")


def phone_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margins and usual durations of some phones, one row a phone: a checked relation of a few rows."""
    n = read_table(spark, sf_dir, "nation").where("n_nationkey < 6")
    k = F.col("n_nationkey")
    return staged(n.select(k.cast("int").alias("phone"), (-0.2 - k * 0.05).alias("fail"), F.when(k % 2 == 0, 0.2 + k * 0.03).alias("pass"), (20.0 + k * 4).alias("usual_ms")))


def _line_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems as aligned phones of an attempt (the order)."""
    li = read_table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_linenumber") == 7, "INSERTION").when(F.col("l_linenumber") == 6, "DELETION").otherwise("MATCH")
    return li.select(F.col("l_orderkey").alias("attempt"), (F.col("l_suppkey") % 12).cast("int").alias("phone"), (F.col("l_discount") + 0.02).alias("p_expected"), (F.col("l_tax") + 0.02).alias("p_other"), (F.col("l_quantity") / 50).alias("confidence"), (F.col("l_quantity") * 2).alias("duration_ms"), kind.alias("kind"))


def phone_threshold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each phone got each status, with the extremes of its scores."""
    s = scored_phones(_line_phones(spark, sf_dir), phone_thresholds(spark, sf_dir))
    return s.groupBy("phone", "verdict").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("score") + 1e-8, 5).alias("least"), F.round(F.max("score") + 1e-8, 5).alias("most"))


def cascade(attempts: DataFrame) -> DataFrame:
    """attempts (acceptable, quality_reason, identity, n_phones, unsure, failed, all_pass) with status and
    reason: quality, then identity, then alignment, then any failure, then positive evidence alone."""
    empty = (F.coalesce("n_phones", F.lit(0)) == 0) | F.col("unsure")
    steps = [
        (~F.col("acceptable"), "RETRY", F.coalesce("quality_reason", F.lit("POOR_QUALITY"))),
        (F.col("identity").isNull() | (F.col("identity") == "UNCERTAIN"), "UNDECIDABLE", F.lit("WORD_IDENTITY_UNCERTAIN")),
        (F.col("identity") == "MISMATCH", "INCORRECT", F.lit("WRONG_WORD")),
        (F.coalesce(empty, F.lit(True)), "UNDECIDABLE", F.lit("ALIGNMENT_UNRELIABLE")),
        (F.col("failed"), "INCORRECT", F.lit("PHONE_ERROR")),
        (F.col("all_pass"), "CORRECT", F.lit("POSITIVE_PHONETIC_EVIDENCE")),
    ]
    status, reason = F.lit("UNDECIDABLE"), F.lit("PHONETIC_EVIDENCE_AMBIGUOUS")
    for test, s, r in reversed(steps):
        status, reason = F.when(test, s).otherwise(status), F.when(test, r).otherwise(reason)
    return attempts.withColumns({"status": status, "reason": reason})


def _phone_sums(scored: DataFrame, key: str) -> DataFrame:
    """What the cascade needs of the phones of each attempt."""
    v = F.col("verdict")
    return scored.groupBy(key).agg(F.count(F.lit(1)).alias("n_phones"), F.bool_or(v == "NOT_SCORABLE").alias("unsure"), F.bool_or(v == "FAIL").alias("failed"), F.bool_and(v == "PASS").alias("all_pass"), F.avg("score").alias("mean_score"))


def pronunciation_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict, reason and mean score of every attempt, attempts without phones included."""
    o = read_table(spark, sf_dir, "orders")
    acceptable = F.col("o_totalprice") >= 5000
    reason = F.when(F.col("o_totalprice") < 2000, "TOO_QUIET")
    identity = F.when(F.col("o_orderpriority") == "1-URGENT", "MISMATCH").when(F.col("o_orderpriority") == "2-HIGH", "UNCERTAIN").when(F.col("o_orderpriority") != "3-MEDIUM", "MATCH").otherwise(F.when(F.col("o_orderkey") % 2 == 0, "MATCH"))
    attempts = o.select(F.col("o_orderkey").alias("attempt"), acceptable.alias("acceptable"), reason.alias("quality_reason"), identity.alias("identity"))
    sums = _phone_sums(scored_phones(_line_phones(spark, sf_dir), phone_thresholds(spark, sf_dir)), "attempt")
    return cascade(attempts.join(sums, "attempt", "left")).select("attempt", "status", "reason", F.round(F.col("mean_score") + 1e-8, 5).alias("pronunciation_score"))


def phonetic_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every recording from its evidence to its verdict: alignment, scores, cascade."""
    own = F.col("end_ms") - F.col("start_ms")
    phones = alignments(spark, sf_dir).select("recording_id", F.coalesce("expected", "observed").alias("phone"), "p_expected", "p_other", "confidence", own.alias("duration_ms"), F.col("status").alias("kind"))
    sums = _phone_sums(scored_phones(phones, phone_thresholds(spark, sf_dir)), "recording_id")
    e = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("recording_id"), F.lit(True).alias("acceptable"), F.lit(None).cast("string").alias("quality_reason"), F.lit("MATCH").alias("identity"))
    return cascade(e.join(sums, "recording_id", "left")).select("recording_id", "status", "reason", F.round("mean_score", 6).alias("pronunciation_score"))


def ordered_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phones of each attempt by start, real ones before insertions, as one string."""
    li = read_table(spark, sf_dir, "lineitem")
    real = F.col("l_linenumber") != 7
    item = F.struct(F.col("l_quantity").cast("int").alias("start"), (~real).alias("extra"), (F.col("l_suppkey") % 12).cast("int").alias("phone"))
    g = li.groupBy(F.col("l_orderkey").alias("attempt")).agg(F.sort_array(F.collect_list(item)).alias("held"))
    return g.select("attempt", F.array_join(F.transform("held", lambda x: F.concat(F.when(x.extra, "+").otherwise(""), x.phone.cast("string"))), " ").alias("phones"))


def word_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of a session that holds its focus word (purchase events): 20 ms more at both ends, from 0
    on, as bytes of 16-bit samples at 16 kHz; sessions without the word have an empty one."""
    e = read_table(spark, sf_dir, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    f = e.select(F.col("user_id").alias("session_id"), "event_type", (n * 40).alias("end_ms"))
    own = F.col("event_type") == "purchase"
    g = f.groupBy("session_id").agg(F.min(F.when(own, F.col("end_ms") - 40)).alias("a"), F.max(F.when(own, F.col("end_ms"))).alias("b"), F.max("end_ms").alias("whole"))
    start, stop = F.greatest(F.lit(0), F.col("a") - 20), F.least(F.col("whole"), F.col("b") + 20)
    return g.select("session_id", (F.coalesce(start, F.lit(0)) * 32).cast("long").alias("first_byte"), (F.coalesce(stop - start, F.lit(0)) * 32).cast("long").alias("bytes"))


def decision_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine signals a learned verdict takes, in their fixed order; what is absent or not a number is 0."""
    o = read_table(spark, sf_dir, "orders")
    signal = F.to_json(F.struct(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice") / 1e6).alias("word_identity_confidence"), F.when(F.col("o_orderkey") % 5 == 0, F.lit("n/a")).otherwise(F.round(F.col("o_totalprice") / 1e5 + 1e-9, 4).cast("string")).alias("pronunciation_score"), (F.col("o_custkey") % 900 + 100).alias("duration_ms")))
    attempts = o.select(F.col("o_orderkey").alias("attempt"), signal.alias("signals"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 4e5).alias("ratio"), F.when(F.col("o_orderstatus") == "O", F.col("o_custkey") % 40).alias("snr"))
    phones = read_table(spark, sf_dir, "lineitem").where("l_linenumber <= 5").groupBy(F.col("l_orderkey").alias("attempt"))
    sums = phones.agg(F.avg("l_discount").alias("s0"), F.min("l_discount").alias("s1"), F.avg(F.col("l_quantity") / 50).alias("c0"), F.min(F.col("l_quantity") / 50).alias("c1"))
    j = attempts.join(sums, "attempt", "left")
    number = lambda name: F.coalesce(F.get_json_object("signals", f"$.{name}").try_cast("double"), F.lit(0.0))
    values = [number("word_identity_confidence"), number("pronunciation_score"), *[F.coalesce(F.col(c), F.lit(0.0)) for c in ("s0", "s1", "c0", "c1")], number("duration_ms"), F.coalesce("ratio", F.lit(0.0)), F.coalesce(F.col("snr").cast("double"), F.lit(0.0))]
    return j.select("attempt", *[(F.round(v + 1e-9, 5) if k != 6 else v).alias(f"f{k}") for k, v in enumerate(values)])


QUERIES = {f.__name__: f for f in (lexicon_lookup, ctc_alignment, phonetic_decisions, phone_threshold_scores, pronunciation_cascade, ordered_phones, word_slice, decision_vector)}
_ENTRIES = ", ".join(f"('{w}', {n}, '{p}')" for w, n, p in (lambda lines: [(w, sum(x.split(" ")[0] == w for x in lines), next(" ".join(x.split(" ")[1:]) for x in lines if x.split(" ")[0] == w)) for w in dict.fromkeys(x.split(" ")[0] for x in lines)])([x for x in LEXICON.split("\n") if x]))
_SCORED = """WITH li AS (SELECT l_orderkey AS attempt, CAST(l_suppkey % 12 AS INT) AS phone, l_quantity / 50 AS confidence, l_linenumber IN (6, 7) AS lost, l_quantity * 2 AS ms,
    ln(greatest(l_discount + 0.02, 1e-9)) - ln(greatest(l_tax + 0.02, 1e-9)) AS odds FROM lineitem),
  th AS (SELECT CAST(n_nationkey AS INT) AS phone, -0.2::DOUBLE - n_nationkey * 0.05::DOUBLE AS fail, CASE WHEN n_nationkey % 2 = 0 THEN 0.2::DOUBLE + n_nationkey * 0.03::DOUBLE END AS ok, 20.0::DOUBLE + n_nationkey * 4 AS usual FROM nation WHERE n_nationkey < 6),
  m AS (SELECT li.*, coalesce(fail, -0.35) AS fail, coalesce(ok, 0.35) AS ok, odds - 0.1::DOUBLE * coalesce(abs(ln(greatest(ms, 1) / usual)), 0) AS margin FROM li LEFT JOIN th USING (phone)),
  sc AS (SELECT *, CASE WHEN lost THEN -20.0::DOUBLE ELSE round(margin, 6) END AS score, CASE WHEN lost THEN 'FAIL' WHEN confidence < 0.2 THEN 'NOT_SCORABLE' WHEN margin <= fail THEN 'FAIL' WHEN margin >= ok THEN 'PASS' ELSE 'BORDERLINE' END AS verdict FROM m) """
ORACLE_SQL = {
    "lexicon_lookup": f"""WITH lx(word, readings, phones) AS (VALUES {_ENTRIES}), t AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z'']+')) AS w FROM conversations),
      c AS (SELECT lower(w) AS word, count(*) AS n FROM t GROUP BY 1)
      SELECT word, n, CAST(coalesce(readings, 0) AS BIGINT) AS readings, phones, CASE WHEN phones IS NULL THEN 'UNDECIDABLE' ELSE 'FOUND' END AS status FROM c LEFT JOIN lx USING (word)""",
    "phone_threshold_scores": _SCORED + "SELECT phone, verdict, count(*) AS n, round(min(score) + 1e-8, 5) AS least, round(max(score) + 1e-8, 5) AS most FROM sc GROUP BY 1, 2",
    "pronunciation_cascade": _SCORED + """, g AS (SELECT attempt, count(*) AS n, bool_or(verdict = 'NOT_SCORABLE') AS unsure, bool_or(verdict = 'FAIL') AS failed, bool_and(verdict = 'PASS') AS ok, avg(score) AS mean FROM sc GROUP BY 1),
      a AS (SELECT o_orderkey AS attempt, o_totalprice AS p, CASE o_orderpriority WHEN '1-URGENT' THEN 'MISMATCH' WHEN '2-HIGH' THEN 'UNCERTAIN' WHEN '3-MEDIUM' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'MATCH' END ELSE 'MATCH' END AS who FROM orders),
      d AS (SELECT a.attempt, mean, CASE WHEN p < 2000 THEN 'RETRY/TOO_QUIET' WHEN p < 5000 THEN 'RETRY/POOR_QUALITY' WHEN who IS NULL OR who = 'UNCERTAIN' THEN 'UNDECIDABLE/WORD_IDENTITY_UNCERTAIN' WHEN who = 'MISMATCH' THEN 'INCORRECT/WRONG_WORD'
        WHEN n IS NULL OR unsure THEN 'UNDECIDABLE/ALIGNMENT_UNRELIABLE' WHEN failed THEN 'INCORRECT/PHONE_ERROR' WHEN ok THEN 'CORRECT/POSITIVE_PHONETIC_EVIDENCE' ELSE 'UNDECIDABLE/PHONETIC_EVIDENCE_AMBIGUOUS' END AS v FROM a LEFT JOIN g USING (attempt))
      SELECT attempt, split_part(v, '/', 1) AS status, split_part(v, '/', 2) AS reason, round(mean + 1e-8, 5) AS pronunciation_score FROM d""",
    "ordered_phones": "SELECT l_orderkey AS attempt, string_agg(CASE WHEN l_linenumber = 7 THEN '+' ELSE '' END || CAST(l_suppkey % 12 AS INT), ' ' ORDER BY CAST(l_quantity AS INT), l_linenumber = 7, l_suppkey % 12) AS phones FROM lineitem GROUP BY 1",
    "word_slice": """WITH f AS (SELECT user_id AS session_id, event_type = 'purchase' AS own, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 40 AS e FROM events),
      g AS (SELECT session_id, greatest(0, min(CASE WHEN own THEN e - 40 END) - 20) AS a, least(max(e), max(CASE WHEN own THEN e END) + 20) AS b, bool_or(own) AS there FROM f GROUP BY 1)
      SELECT session_id, CAST(CASE WHEN there THEN a * 32 ELSE 0 END AS BIGINT) AS first_byte, CAST(CASE WHEN there THEN (b - a) * 32 ELSE 0 END AS BIGINT) AS bytes FROM g""",
    "decision_vector": """WITH p AS (SELECT l_orderkey AS k, avg(l_discount) AS s0, min(l_discount) AS s1, avg(l_quantity / 50) AS c0, min(l_quantity / 50) AS c1 FROM lineitem WHERE l_linenumber <= 5 GROUP BY 1)
      SELECT o_orderkey AS attempt, round(CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice / 1e6 ELSE 0 END + 1e-9, 5) AS f0, round(CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE round(o_totalprice / 1e5 + 1e-9, 4) END + 1e-9, 5) AS f1,
        round(coalesce(s0, 0) + 1e-9, 5) AS f2, round(coalesce(s1, 0) + 1e-9, 5) AS f3, round(coalesce(c0, 0) + 1e-9, 5) AS f4, round(coalesce(c1, 0) + 1e-9, 5) AS f5, CAST(o_custkey % 900 + 100 AS DOUBLE) AS f6,
        round(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 4e5 ELSE 0 END + 1e-9, 5) AS f7, round(CASE WHEN o_orderstatus = 'O' THEN o_custkey % 40 ELSE 0 END + 1e-9, 5) AS f8 FROM orders LEFT JOIN p ON k = o_orderkey""",
}
