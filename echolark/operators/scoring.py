"""Distances to decisions: prototypes, margins, gates, ensembles and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echolark.core import broadcast_if_small, read_table, staged
from echolark.operators.neighbours import nearest
from echolark.operators.selection import exact_quantiles
from echolark.plans.domain import DIST_SQL, LOGS_SQL, REC_SQL, decision_logs, distances, euclid, recordings


def four_state(distance: Column, accept: Column, reject: Column, retry: Column) -> Column:
    """RETRY, then invalid, then at most accept, then at least reject; else undecidable. Accept has to
    lie below reject."""
    accept = F.when(accept < reject, accept).otherwise(F.raise_error(F.lit("accept is not below reject")).cast("double"))
    invalid = distance.isNull() | F.isnan(distance) | (distance < 0) | (F.abs(distance) == float("inf"))
    return F.when(retry, "RETRY").when(invalid, "UNDECIDABLE").when(distance <= accept, "CORRECT").when(distance >= reject, "INCORRECT").otherwise("UNDECIDABLE")


FALLBACK = 20


def calibrating(d: DataFrame) -> DataFrame:
    """The rows of staged distances that thresholds come from, with `own`, whether a row is of its candidate's
    word: validation rows and, for own rows of a word that validation has none of, its first FALLBACK
    training recordings."""
    own = F.col("word") == F.col("candidate")
    bare = d.groupBy("candidate").agg(F.count_if(own & (F.col("split") == "validation")).alias("n")).where("n = 0").select("candidate")
    if bare.isEmpty():
        return d.where("split = 'validation'").withColumn("own", own)
    bare = broadcast_if_small(staged(bare))
    first = d.where(own & (F.col("split") == "train")).join(bare, "candidate").groupBy("candidate").agg(F.slice(F.sort_array(F.collect_set("recording_id")), 1, FALLBACK).alias("ids"))
    first = first.select("candidate", F.explode("ids").alias("recording_id"))
    used = d.where("split = 'validation'").union(d.where(own).join(first, ["candidate", "recording_id"]).select(d.columns))
    return used.withColumn("own", own)


def thresholds(d: DataFrame, step: float) -> DataFrame:
    """Per candidate of staged distances: accept is the lesser of positives' p90 and negatives' p10, reject lies
    `step` above at least."""
    used = calibrating(d)
    mine = exact_quantiles(used.where("own"), "candidate", "distance", {"p90": 0.9, "p97": 0.97})
    others = exact_quantiles(used.where("not own"), "candidate", "distance", {"n10": 0.1})
    q = mine.join(others, "candidate", "left")
    accept = F.round(F.least("p90", F.coalesce("n10", "p90")), 9)
    return q.select("candidate", accept.alias("accept"), F.round(F.greatest(accept + step, F.col("p97")), 9).alias("reject"))


def margins(d: DataFrame) -> DataFrame:
    """Per recording: own distance, nearest competitor (first word among equals) and margin."""
    own = F.max(F.when(F.col("word") == F.col("candidate"), F.col("distance")))
    best = F.min(F.when(F.col("word") != F.col("candidate"), F.struct("distance", "candidate")))
    out = d.groupBy("recording_id", "word", "split").agg(own.alias("own"), best.alias("best"))
    return out.select("recording_id", "word", "split", "own", F.col("best.candidate").alias("competitor"), F.col("best.distance").alias("other"), F.round(F.col("best.distance") - F.col("own"), 9).alias("margin"))


THRESHOLDS_SQL = DIST_SQL + """,
q AS (SELECT candidate, quantile_cont(CASE WHEN word = candidate THEN distance END, 0.9) AS p90, quantile_cont(CASE WHEN word = candidate THEN distance END, 0.97) AS p97,
        quantile_cont(CASE WHEN word <> candidate THEN distance END, 0.1) AS n10 FROM dist WHERE split = 'validation' GROUP BY candidate),
th AS (SELECT candidate, round(least(p90, coalesce(n10, p90)), 9) AS accept, round(greatest(round(least(p90, coalesce(n10, p90)), 9) + {step}, p97), 9) AS reject FROM q),
mg AS (SELECT recording_id, word, split, max(CASE WHEN word = candidate THEN distance END) AS own,
         min(CASE WHEN word <> candidate THEN struct_pack(d := distance, c := candidate) END) AS best FROM dist GROUP BY ALL),
mm AS (SELECT recording_id, word, split, own, best.c AS competitor, best.d AS other, round(best.d - own, 9) AS margin FROM mg)
"""


def nearest_prototype_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = staged(distances(spark, sf_dir))
    own = d.where("word = candidate").join(broadcast_if_small(thresholds(d, 0.05)), "candidate")
    return own.select("recording_id", "word", "split", F.round("distance", 6).alias("distance"), four_state(F.col("distance"), F.col("accept"), F.col("reject"), F.lit(False)).alias("status"))


def acoustic_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thresholds(staged(distances(spark, sf_dir)), 0.05).select("candidate", F.round("accept", 6).alias("accept"), F.round("reject", 6).alias("reject"))


def contrastive_verdict(retry: Column) -> tuple[Column, Column]:
    """Status and reason of rows with own, other, margin, accept, reject and required, the first rule that holds:
    retry, values that are not distances, close and ahead of the next word, far, behind the next word."""
    wrong = lambda c: F.col(c).isNull() | F.isnan(c) | (F.col(c) < 0) | (F.abs(c) == float("inf"))
    rules = [(retry, "RETRY", "AUDIO_QUALITY"), (wrong("own") | wrong("other"), "UNDECIDABLE", "INVALID"),
             ((F.col("own") <= F.col("accept")) & (F.col("margin") >= F.col("required")), "CORRECT", "WITHIN_ACCEPT"),
             (F.col("own") >= F.col("reject"), "INCORRECT", "DISTANCE"), (F.col("margin") <= -F.col("required"), "INCORRECT", "MARGIN")]
    status, reason = F.when(rules[0][0], rules[0][1]), F.when(rules[0][0], rules[0][2])
    for holds, verdict, why in rules[1:]:
        status, reason = status.when(holds, verdict), reason.when(holds, why)
    return status.otherwise("UNDECIDABLE"), reason.otherwise("AMBIGUOUS")


def contrastive_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margins of every recording with the thresholds of its word."""
    d = staged(distances(spark, sf_dir))
    m = staged(margins(d))
    used = m.join(calibrating(d).where("own").select("recording_id", "word").distinct(), ["recording_id", "word"])
    least = exact_quantiles(used, "word", "margin", {"p10": 0.1}).select("word", F.round(F.greatest(F.lit(0.01), F.col("p10")), 9).alias("required"))
    return m.join(broadcast_if_small(thresholds(d, 0.02).withColumnRenamed("candidate", "word")), "word").join(broadcast_if_small(staged(least)), "word")


def contrastive_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, reason = contrastive_verdict(F.lit(False))
    return contrastive_rows(spark, sf_dir).select("recording_id", "word", "competitor", F.round("margin", 6).alias("margin"), status.alias("status"), reason.alias("reason"))


def identity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two nearest words, softmax confidence of the nearest, and match, mismatch or uncertain by margin."""
    w = Window.partitionBy("recording_id")
    d = distances(spark, sf_dir).withColumn("p", F.exp(-F.col("distance") - F.max(-F.col("distance")).over(w)))
    d = d.withColumn("p", F.col("p") / F.sum("p").over(w)).withColumn("rk", F.row_number().over(w.orderBy("distance", "candidate")))
    g = d.groupBy("recording_id", "word").agg(F.max(F.when(F.col("rk") == 1, F.col("candidate"))).alias("nearest"), F.max(F.when(F.col("rk") == 1, F.col("p"))).alias("confidence"), F.max(F.when(F.col("rk") == 2, F.col("distance"))).alias("d2"), F.max(F.when(F.col("rk") == 1, F.col("distance"))).alias("d1"))
    margin = F.round(F.col("d2") - F.col("d1"), 9)
    gate = F.when(margin.isNull() | (margin < 0.05), "UNCERTAIN").when(F.col("nearest") == F.col("word"), "MATCH").otherwise("MISMATCH")
    return g.select("recording_id", "word", "nearest", F.round("confidence", 6).alias("confidence"), F.round(margin, 6).alias("margin"), gate.alias("gate"))


GATE_SQL = DIST_SQL + """,
p AS (SELECT *, exp(-distance - max(-distance) OVER (PARTITION BY recording_id)) AS e, row_number() OVER (PARTITION BY recording_id ORDER BY distance, candidate) AS rk FROM dist),
s AS (SELECT *, e / sum(e) OVER (PARTITION BY recording_id) AS pr FROM p),
g AS (SELECT recording_id, word, max(CASE WHEN rk = 1 THEN candidate END) AS nearest, max(CASE WHEN rk = 1 THEN pr END) AS confidence,
        round(max(CASE WHEN rk = 2 THEN distance END) - max(CASE WHEN rk = 1 THEN distance END), 9) AS m FROM s GROUP BY ALL),
gt AS (SELECT recording_id, word, nearest, round(confidence, 6) AS confidence, round(m, 6) AS margin,
         CASE WHEN m IS NULL OR m < 0.05 THEN 'UNCERTAIN' WHEN nearest = word THEN 'MATCH' ELSE 'MISMATCH' END AS gate FROM g)
"""


def gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = staged(identity_gate(spark, sf_dir))
    p95 = exact_quantiles(g.select(F.lit(0).alias("all"), "margin"), "all", "margin", {"p95": 0.95})
    n, words = F.count(F.lit(1)), F.countDistinct("word")
    return g.groupBy().agg(n.alias("n"), F.count_if(F.col("gate") == "MATCH").alias("matches"), F.count_if(F.col("gate") == "MISMATCH").alias("mismatches"), F.count_if(F.col("gate") == "UNCERTAIN").alias("uncertain"), F.round(F.count_if(F.col("gate") == "MATCH") / n, 6).alias("accuracy"), F.round(F.count_if(F.col("gate") == "MISMATCH") / (n * (words - 1)), 8).alias("pair_far")).withColumn("all", F.lit(0)).join(p95, "all", "left").withColumn("margin_p95", F.round("p95", 6)).drop("all", "p95")


def robust_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and scaled MAD of each dimension over training rows; standard deviation, then 1, where MAD is nil."""
    x = recordings(spark, sf_dir).where("split = 'train'").select(F.posexplode("feature").alias("dim", "x"))
    x = staged(x)
    sd = x.groupBy("dim").agg(F.stddev_pop("x").alias("sd"))
    center = staged(exact_quantiles(x, "dim", "x", {"center": 0.5}))
    off = x.join(broadcast_if_small(center), "dim").select("dim", F.abs(F.col("x") - F.col("center")).alias("off"))
    mad = center.join(exact_quantiles(off, "dim", "off", {"mad": 0.5}), "dim").join(sd, "dim").withColumn("mad", F.col("mad") * 1.4826)
    return mad.select("dim", F.round("center", 6).alias("center"), F.round(F.when(F.col("mad") > 1e-6, F.col("mad")).when(F.col("sd") > 1e-6, F.col("sd")).otherwise(1.0), 6).alias("scale"))


def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three nearest training recordings by cosine of every validation recording, exactly, by the pruned search over
    all rows. Cosines with vectors of no length or of values that are not finite are NaN, which ranks first, as in
    SQL; those with missing vectors are null and rank last."""
    recs = recordings(spark, sf_dir)
    dims = recs.agg(F.max(F.size("feature"))).first()[0] or 0
    size = F.sqrt(F.aggregate("feature", F.lit(0.0), lambda s, x: s + x * x))
    kind = F.when((F.size("feature") != dims) | F.col("size").isNull(), "missing").when((F.col("size") > 0) & (F.col("size") < float("inf")), "fine").otherwise("nan")
    recs = recs.withColumn("size", size).select("split", F.col("recording_id").alias("id"), "feature", "size", kind.alias("kind"))
    train, asked = recs.where("split = 'train'"), recs.where("split = 'validation'")
    unit = lambda df: df.where("kind = 'fine'").select(F.lit("all").alias("group"), "id", F.transform("feature", lambda x: x / F.col("size")).alias("u"))
    found = nearest(unit(train), unit(asked), 3).select(F.col("query").alias("query_id"), F.col("id").alias("recording_id"), "similarity")
    # cosines without a value tie, so the first ids of each kind are all that can be among the three
    few = train.select("id", "kind").withColumn("k", F.row_number().over(Window.partitionBy("kind").orderBy("id"))).where("k <= 4")
    odd = asked.select(F.col("id").alias("query_id"), F.col("kind").alias("query_kind")).crossJoin(F.broadcast(few)).where("id <> query_id and (kind <> 'fine' or query_kind <> 'fine')")
    similarity = F.when((F.col("kind") == "missing") | (F.col("query_kind") == "missing"), F.lit(None)).otherwise(float("nan"))
    pairs = found.union(odd.select("query_id", F.col("id").alias("recording_id"), similarity.alias("similarity")))
    rk = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "recording_id"))
    return pairs.withColumn("rank", rk).where("rank <= 3")


def pairwise_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symmetric distances among at most 36 training recordings of each word."""
    recs = recordings(spark, sf_dir).where("split = 'train'")
    c = recs.withColumn("k", F.row_number().over(Window.partitionBy("word").orderBy("recording_id"))).where("k <= 36")
    b = c.select("word", F.col("recording_id").alias("right_id"), F.col("feature").alias("g"))
    half = c.join(b, "word").where("recording_id < right_id").select("word", F.col("recording_id").alias("left_id"), "right_id", F.round(euclid(F.col("feature"), F.col("g")), 6).alias("distance"))
    return half.union(half.select("word", F.col("right_id"), F.col("left_id"), "distance"))




def threshold_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = decision_logs(spark, sf_dir)
    return logs.select("attempt_id", four_state(F.col("latency") / 100, F.lit(0.25), F.lit(0.75), F.col("status") == "RETRY").alias("decision"))


def weighted_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights 0.6, 0.25 and 0.15 over the components that are there, renormalised; 0.65 decides; RETRY sticks."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") != "N", 1 - F.col("l_discount") * 5).alias("phonetic"), F.when(F.col("l_linestatus") == "O", F.col("l_tax") * 10).alias("dtw"), (F.col("l_quantity") / 50).alias("single"))
    parts = [(F.col("phonetic"), 0.6), (F.col("dtw"), 0.25), (F.col("single"), 0.15)]
    weight = sum((F.when(c.isNotNull(), F.lit(w)).otherwise(0.0) for c, w in parts), F.lit(0.0))
    score = sum((F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) * w).otherwise(0.0) for c, w in parts), F.lit(0.0)) / weight
    s = li.withColumn("s", F.round(score + 1e-10, 6))
    return s.groupBy("l_orderkey").agg(F.count_if(F.col("s") >= 0.65).alias("correct"), F.count_if(F.col("s") < 0.65).alias("incorrect"), F.round(F.avg("s") + 1e-9, 5).alias("mean_score"), F.round(F.max(F.abs(F.col("s") - 0.5) * 2) + 1e-9, 5).alias("confidence"))


QUERIES = {f.__name__: f for f in (nearest_prototype_decision, acoustic_thresholds, contrastive_decision, identity_gate, gate_report, robust_scale, knn_cosine, pairwise_distance, threshold_decide, weighted_ensemble)}
ORACLE_SQL = {
    "nearest_prototype_decision": THRESHOLDS_SQL.format(step=0.05) + "SELECT recording_id, word, split, round(distance, 6) AS distance, CASE WHEN distance <= accept THEN 'CORRECT' WHEN distance >= reject THEN 'INCORRECT' ELSE 'UNDECIDABLE' END AS status FROM dist JOIN th USING (candidate) WHERE word = candidate",
    "acoustic_thresholds": THRESHOLDS_SQL.format(step=0.05) + "SELECT candidate, round(accept, 6) AS accept, round(reject, 6) AS reject FROM th",
    "contrastive_decision": THRESHOLDS_SQL.format(step=0.02) + """, rq AS (SELECT word, round(greatest(0.01, quantile_cont(margin, 0.1)), 9) AS required FROM mm WHERE split = 'validation' GROUP BY word)
      SELECT recording_id, word, competitor, round(margin, 6) AS margin,
        CASE WHEN own <= accept AND margin >= required THEN 'CORRECT' WHEN own >= reject OR margin <= -required THEN 'INCORRECT' ELSE 'UNDECIDABLE' END AS status,
        CASE WHEN own <= accept AND margin >= required THEN 'WITHIN_ACCEPT' WHEN own >= reject THEN 'DISTANCE' WHEN margin <= -required THEN 'MARGIN' ELSE 'AMBIGUOUS' END AS reason
      FROM mm JOIN th ON th.candidate = mm.word JOIN rq USING (word)""",
    "identity_gate": GATE_SQL + "SELECT * FROM gt",
    "gate_report": GATE_SQL + "SELECT count(*) AS n, count_if(gate = 'MATCH') AS matches, count_if(gate = 'MISMATCH') AS mismatches, count_if(gate = 'UNCERTAIN') AS uncertain, round(count_if(gate = 'MATCH') / count(*), 6) AS accuracy, round(count_if(gate = 'MISMATCH') / (count(*) * (count(DISTINCT word) - 1)), 8) AS pair_far, round(quantile_cont(margin, 0.95), 6) AS margin_p95 FROM gt",
    "robust_scale": REC_SQL + """, c AS (SELECT d, quantile_cont(x, 0.5) AS center, stddev_pop(x) AS sd FROM lng WHERE split = 'train' GROUP BY d),
      m AS (SELECT d, center, sd, quantile_cont(abs(x - center), 0.5) * 1.4826 AS mad FROM lng JOIN c USING (d) WHERE split = 'train' GROUP BY ALL)
      SELECT CAST(d - 1 AS INT) AS dim, round(center, 6) AS center, round(CASE WHEN mad > 1e-6 THEN mad WHEN sd > 1e-6 THEN sd ELSE 1.0 END, 6) AS scale FROM m""",
    "knn_cosine": REC_SQL + """, p AS (SELECT q.recording_id AS query_id, r.recording_id, round(list_cosine_similarity(r.feature, q.feature), 6) AS similarity FROM spl r JOIN spl q ON r.recording_id <> q.recording_id WHERE r.split = 'train' AND q.split = 'validation')
      SELECT query_id, recording_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, recording_id) AS rank FROM p QUALIFY rank <= 3""",
    "pairwise_distance": REC_SQL + """, c AS (SELECT * FROM spl WHERE split = 'train' QUALIFY row_number() OVER (PARTITION BY word ORDER BY recording_id) <= 36)
      SELECT a.word, a.recording_id AS left_id, b.recording_id AS right_id, round(list_distance(a.feature, b.feature) / sqrt(26), 6) AS distance FROM c a JOIN c b ON a.word = b.word AND a.recording_id <> b.recording_id""",
    "threshold_decide": LOGS_SQL + " SELECT attempt_id, CASE WHEN status = 'RETRY' THEN 'RETRY' WHEN latency IS NULL OR latency < 0 THEN 'UNDECIDABLE' WHEN latency / 100 <= 0.25 THEN 'CORRECT' WHEN latency / 100 >= 0.75 THEN 'INCORRECT' ELSE 'UNDECIDABLE' END AS decision FROM lg",
    "weighted_ensemble": """WITH c AS (SELECT l_orderkey, CASE WHEN l_returnflag <> 'N' THEN greatest(0.0, least(1.0, 1 - l_discount * 5)) END AS p, CASE WHEN l_linestatus = 'O' THEN greatest(0.0, least(1.0, l_tax * 10)) END AS d, greatest(0.0, least(1.0, l_quantity / 50)) AS s FROM lineitem),
      e AS (SELECT l_orderkey, round((coalesce(p * 0.6::DOUBLE, 0) + coalesce(d * 0.25::DOUBLE, 0) + coalesce(s * 0.15::DOUBLE, 0)) / (CASE WHEN p IS NULL THEN 0.0::DOUBLE ELSE 0.6::DOUBLE END + CASE WHEN d IS NULL THEN 0.0::DOUBLE ELSE 0.25::DOUBLE END + 0.15::DOUBLE) + 1e-10, 6) AS s FROM c)
      SELECT l_orderkey, count_if(s >= 0.65) AS correct, count_if(s < 0.65) AS incorrect, round(avg(s) + 1e-9, 5) AS mean_score, round(max(abs(s - 0.5) * 2) + 1e-9, 5) AS confidence FROM e GROUP BY 1""",
}
