"""Phone scores and verdicts, error-rate calibration, drift and learning features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echolark.core import broadcast_if_small, read_table
from echolark.operators.selection import exact_quantiles

FAIL, PASS, LEAST_CONFIDENCE = -0.35, 0.35, 0.2


def phone_score(expected: Column, rival: Column, duration: Column, usual: Column, weight: float = 0.1) -> Column:
    """Log odds of the expected phone over its rival, less a penalty for an odd duration."""
    log = lambda x: F.ln(F.greatest(x, F.lit(1e-9)))
    return log(expected) - log(rival) - weight * F.abs(F.ln(duration / usual))


def _phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems as aligned phones: an order is an attempt, a part kind a word."""
    li = read_table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_linenumber") == 7, "INSERTION").otherwise("MATCH")
    score = F.when(kind == "INSERTION", -20.0).otherwise(F.round(phone_score(F.col("l_discount") + 0.02, F.col("l_tax") + 0.02, F.col("l_quantity"), F.lit(25.0)), 9))
    status = F.when(kind == "INSERTION", "FAIL").when(F.col("l_quantity") / 50 < LEAST_CONFIDENCE, "NOT_SCORABLE").when(score <= FAIL, "FAIL").when(score >= PASS, "PASS").otherwise("BORDERLINE")
    return li.select(F.col("l_orderkey").alias("attempt"), (F.col("l_partkey") % 3).alias("word"), score.alias("score"), status.alias("status"), (F.col("l_quantity") / 50).alias("confidence"))


def phone_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _phones(spark, sf_dir).groupBy("attempt", "status").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("score") + 1e-8, 6).alias("least"), F.round(F.max("score") + 1e-8, 6).alias("most"))


def word_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _phones(spark, sf_dir).groupBy("attempt", "word").agg(F.bool_or(F.col("status") == "FAIL").alias("fail"), F.bool_and(F.col("status") == "PASS").alias("pass"))
    return p.select("attempt", "word", F.when(F.col("fail"), "INCORRECT").when(F.col("pass"), "CORRECT").otherwise("UNDECIDABLE").alias("status"))


def decision_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not scorable, then any failure, then all passes; else ambiguous."""
    g = _phones(spark, sf_dir).groupBy("attempt").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("status") == "NOT_SCORABLE").alias("ns"), F.bool_or(F.col("status") == "FAIL").alias("fail"), F.bool_and(F.col("status") == "PASS").alias("ok"))
    verdict = F.when(F.col("n") < 2, "RETRY").when(F.col("ns"), "UNDECIDABLE").when(F.col("fail"), "INCORRECT").when(F.col("ok"), "CORRECT").otherwise("UNDECIDABLE")
    return g.select("attempt", verdict.alias("status"))


def decision_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _phones(spark, sf_dir).where("score > -20").groupBy("attempt")
    return g.agg(F.round(F.avg("score") + 1e-9, 5).alias("mean_score"), F.round(F.min("score"), 5).alias("min_score"), F.round(F.avg("confidence") + 1e-9, 5).alias("mean_confidence"), F.round(F.min("confidence"), 5).alias("min_confidence"))


def calibrate_far_frr(spark: SparkSession, sf_dir: str, max_far: float = 0.9, max_frr: float = 0.9) -> DataFrame:
    """Per language, the length threshold with the least sum of false accepts and rejects among those feasible.

    Counts above and below each candidate are running sums over distinct values, so no pair of rows meets.
    """
    s = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(read_table(spark, sf_dir, "labels"), "doc_id")
    v = s.groupBy("lang", "n_chars").agg(F.count_if(F.col("quality") == 0).alias("bad"), F.count_if(F.col("quality") == 1).alias("good"))
    w = Window.partitionBy("lang")
    upto = w.orderBy("n_chars").rowsBetween(Window.unboundedPreceding, 0)
    c = v.withColumns({"above": F.sum("bad").over(w) - F.sum("bad").over(upto), "below": F.sum("good").over(upto), "nb": F.sum("bad").over(w), "ng": F.sum("good").over(w)})
    c = c.withColumns({"far": F.try_divide("above", "nb"), "frr": F.try_divide("below", "ng")}).where((F.col("far") <= max_far) & (F.col("frr") <= max_frr))
    best = c.groupBy("lang").agg(F.min(F.struct(F.round(F.col("far") + F.col("frr"), 9).alias("total"), F.round("far", 9).alias("far"), F.col("n_chars").alias("t"), F.round("frr", 9).alias("frr"))).alias("b"))
    return best.select("lang", F.col("b.t").alias("threshold"), F.round("b.far", 6).alias("far"), F.round("b.frr", 6).alias("frr"))


def psi_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population stability of event values between even and odd users, by event type, over ten quantile bins."""
    e = read_table(spark, sf_dir, "events").select("event_type", "value", (F.col("user_id") % 2).alias("side"))
    tenths = {f"q{k}": k / 10 for k in range(1, 10)}
    edges = exact_quantiles(e.where("side = 0"), "event_type", "value", tenths).select("event_type", F.array_distinct(F.array(*tenths)).alias("edges"))
    b = e.join(broadcast_if_small(edges), "event_type").withColumn("bin", F.size(F.filter("edges", lambda x: x <= F.col("value"))))
    h = b.groupBy("event_type", "bin").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    w = Window.partitionBy("event_type")
    share = lambda c: F.greatest(F.coalesce(F.try_divide(F.col(c), F.sum(c).over(w)), F.lit(0.0)), F.lit(1e-6))
    h = h.withColumns({"pa": share("a"), "pb": share("b")})
    return h.groupBy("event_type").agg(F.round(F.sum((F.col("pb") - F.col("pa")) * F.ln(F.col("pb") / F.col("pa"))), 6).alias("psi"))


QUERIES = {f.__name__: f for f in (phone_scores, word_status, decision_cascade, decision_features, calibrate_far_frr, psi_drift)}
_PH = """WITH a AS (SELECT l_orderkey AS attempt, l_partkey % 3 AS word, l_quantity / 50 AS confidence, CASE WHEN l_linenumber = 7 THEN 'INSERTION' ELSE 'MATCH' END AS kind,
  CASE WHEN l_linenumber = 7 THEN -20.0::DOUBLE ELSE round(ln(greatest(l_discount + 0.02, 1e-9)) - ln(greatest(l_tax + 0.02, 1e-9)) - 0.1 * abs(ln(l_quantity / 25.0)), 9) END AS score FROM lineitem),
 ph AS (SELECT *, CASE WHEN kind = 'INSERTION' THEN 'FAIL' WHEN confidence < 0.2 THEN 'NOT_SCORABLE' WHEN score <= -0.35 THEN 'FAIL' WHEN score >= 0.35 THEN 'PASS' ELSE 'BORDERLINE' END AS status FROM a) """
ORACLE_SQL = {
    "phone_scores": _PH + "SELECT attempt, status, count(*) AS n, round(min(score) + 1e-8, 6) AS least, round(max(score) + 1e-8, 6) AS most FROM ph GROUP BY 1, 2",
    "word_status": _PH + "SELECT attempt, word, CASE WHEN bool_or(status = 'FAIL') THEN 'INCORRECT' WHEN bool_and(status = 'PASS') THEN 'CORRECT' ELSE 'UNDECIDABLE' END AS status FROM ph GROUP BY 1, 2",
    "decision_cascade": _PH + "SELECT attempt, CASE WHEN count(*) < 2 THEN 'RETRY' WHEN bool_or(status = 'NOT_SCORABLE') THEN 'UNDECIDABLE' WHEN bool_or(status = 'FAIL') THEN 'INCORRECT' WHEN bool_and(status = 'PASS') THEN 'CORRECT' ELSE 'UNDECIDABLE' END AS status FROM ph GROUP BY 1",
    "decision_features": _PH + "SELECT attempt, round(avg(score) + 1e-9, 5) AS mean_score, round(min(score), 5) AS min_score, round(avg(confidence) + 1e-9, 5) AS mean_confidence, round(min(confidence), 5) AS min_confidence FROM ph WHERE score > -20 GROUP BY 1",
    "calibrate_far_frr": """WITH s AS (SELECT lang, n_chars, quality FROM documents JOIN labels USING (doc_id)), t AS (SELECT DISTINCT lang, n_chars AS t FROM s),
      r AS (SELECT t.lang, t.t, count_if(quality = 0 AND n_chars > t.t) / nullif(count_if(quality = 0), 0) AS far, count_if(quality = 1 AND n_chars <= t.t) / nullif(count_if(quality = 1), 0) AS frr FROM t JOIN s USING (lang) GROUP BY 1, 2)
      SELECT lang, t AS threshold, round(far, 6) AS far, round(frr, 6) AS frr FROM r WHERE far <= 0.9 AND frr <= 0.9 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY round(far + frr, 9), round(far, 9), t) = 1""",
    "psi_drift": """WITH e AS (SELECT event_type, value, user_id % 2 AS side FROM events), q AS (SELECT event_type, quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM e WHERE side = 0 GROUP BY 1),
      b AS (SELECT e.*, len(list_filter(edges, lambda x: x <= value)) AS bin FROM e JOIN q USING (event_type)), h AS (SELECT event_type, bin, count_if(side = 0) AS a, count_if(side = 1) AS b FROM b GROUP BY 1, 2),
      s AS (SELECT event_type, greatest(coalesce(a / nullif(sum(a) OVER (PARTITION BY event_type), 0), 0), 1e-6) AS pa, greatest(coalesce(b / nullif(sum(b) OVER (PARTITION BY event_type), 0), 0), 1e-6) AS pb FROM h)
      SELECT event_type, round(sum((pb - pa) * ln(pb / pa)), 6) AS psi FROM s GROUP BY 1""",
}
