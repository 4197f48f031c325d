"""Pronunciation variants, positions, label runs, confidence, cleaning reports and a learned verdict."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echolark.core import broadcast_if_small, hold, read_table, shared_dir, staged
from echolark.functions.cleaning import REPORT, clean_pcm
from echolark.operators.calibration import _PH, _phones
from echolark.operators.kernels import SLICE, audio
from echolark.operators.scoring import THRESHOLDS_SQL, thresholds
from echolark.plans.domain import distances

TREES, DEPTH, LEAST_LEAF, LEAST_ROWS = 300, 12, 5, 500


def best_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word reading with the highest sum of phone scores in each attempt; the first on ties."""
    sums = _phones(spark, sf_dir).groupBy("attempt", "word").agg((F.round(F.sum("score") + 1e-8, 6)).alias("total"))
    best = sums.groupBy("attempt").agg(F.max(F.struct("total", (-F.col("word")).alias("minus"))).alias("b"))
    return best.select("attempt", (-F.col("b.minus")).alias("word"), "b.total")


def phones_to_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token that each phone position falls to: tokens take consecutive slices as long as their entry."""
    li = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("attempt"), "l_linenumber", (F.col("l_suppkey") % 3 + 1).alias("length"))
    upto = Window.partitionBy("attempt").orderBy("l_linenumber")
    tokens = li.select("attempt", F.col("l_linenumber").alias("token"), F.sum("length").over(upto).alias("stop"), "length")
    tokens = tokens.select(F.col("attempt").alias("of"), "token", (F.col("stop") - F.col("length")).alias("start"), "stop")
    phones = li.select("attempt", (F.col("l_linenumber") - 1).alias("position"))
    return phones.join(tokens, (F.col("of") == F.col("attempt")) & (F.col("position") >= F.col("start")) & (F.col("position") < F.col("stop"))).select("attempt", "position", "token")


def label_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacent frames of one label in a session, merged."""
    e = read_table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.withColumns({"n": F.row_number().over(w), "last": F.lag("event_type").over(w)})
    e = e.withColumn("run", F.sum(F.when(F.col("last").eqNullSafe(F.col("event_type")), 0).otherwise(1)).over(w))
    return e.groupBy(F.col("user_id").alias("session_id"), "run").agg(F.min("event_type").alias("label"), F.min("n").alias("first_frame"), F.max("n").alias("last_frame"))


def acoustic_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and confidence of each recording against its own word's thresholds."""
    d = staged(distances(spark, sf_dir))
    j = d.where("word = candidate").join(broadcast_if_small(thresholds(d, 0.05)), "candidate")
    x, accept, reject = F.col("distance"), F.col("accept"), F.col("reject")
    sure = F.when(x <= accept, F.least(F.lit(1.0), accept / F.greatest(x, F.lit(1e-9)))).when(x >= reject, F.least(F.lit(1.0), x / reject - 1)).otherwise(F.abs(x - (accept + reject) / 2) / (reject - accept))
    return j.select("recording_id", "word", F.round(F.exp(-x), 6).alias("score"), F.round(sure, 6).alias("confidence"))


def cleaning_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each recording's audio after cleaning; the audio itself stays out of the result."""

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            for k in range(0, len(b), SLICE):
                part = b[k : k + SLICE]
                found = [[v for v, n in zip(clean_pcm(bytes(3200) + audio(x) + bytes(3200)), names, strict=True) if n != "pcm"] for x in part.embedding]
                yield pd.DataFrame(found, columns=[n for n in names if n != "pcm"]).assign(recording_id=part.recording_id.to_numpy())

    names = [c.split()[0] for c in REPORT.split(", ")]
    rows = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("recording_id"), "embedding")
    return rows.mapInPandas(batches, REPORT.removesuffix(", pcm binary") + ", recording_id long")


def fit_forest(rows: DataFrame, features: list[str], label: str, trees: int = TREES, depth: int = DEPTH):
    """A forest with classes balanced by weight; rows below LEAST_ROWS or of one class are refused."""
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if sum(counts.values()) < LEAST_ROWS or len(counts) != 2:
        raise ValueError(f"a forest needs {LEAST_ROWS} rows of two classes, found {counts}")
    weight = F.lit(0.0)
    for value, n in counts.items():
        weight = F.when(F.col(label) == value, sum(counts.values()) / (2 * n)).otherwise(weight)
    vectors = VectorAssembler(inputCols=features, outputCol="_features").transform(rows.withColumn("_weight", weight))
    forest = RandomForestClassifier(featuresCol="_features", labelCol=label, weightCol="_weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=LEAST_LEAF, seed=42)
    # each level finds a row's node by its number, not by walking down every tree again; the trees are the same
    return forest.setCacheNodeIds(True).fit(vectors)


FEATURES = ["mean_score", "min_score", "mean_confidence", "min_confidence"]
FEATURE_SCHEMA = "attempt-features-1"


def by_speaker(rows: DataFrame, speaker: str) -> DataFrame:
    """rows with `split`: three fifths of the speakers train, a fifth each validates and tests, so that none is in two."""
    u = F.pmod(F.xxhash64(F.lit("split"), speaker), F.lit(5))
    return rows.withColumn("split", F.when(u < 3, "train").when(u == 3, "validation").otherwise("test"))


def save_forest(rows: DataFrame, path: str, version: str, trees: int = TREES, depth: int = DEPTH) -> dict:
    """Learns a forest on the training rows of rows (FEATURES, label, split, rule), saves it under `path` with its
    report and returns that. The report has the counts of the splits, the accuracy on those held out, that of
    the rule on the test rows as a baseline, and a digest of the saved trees."""
    spark = rows.sparkSession
    model = fit_forest(rows.where("split = 'train'"), FEATURES, "label", trees, depth)
    model.write().overwrite().save(f"{path}/model")
    held = applied_forest(model, rows).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("accuracy"), F.avg((F.col("rule") == F.col("label")).cast("double")).alias("rule"))
    found = {r.split: r for r in held.collect()}
    if missing := {"train", "validation", "test"} - set(found):
        raise ValueError(f"no rows to {', '.join(sorted(missing))}")
    report = {f"{s}_count": found[s].n for s in ("train", "validation", "test")}
    report |= {"model_version": version, "feature_schema": FEATURE_SCHEMA, "features": FEATURES, "validation_accuracy": found["validation"].accuracy, "test_accuracy": found["test"].accuracy, "rule_test_accuracy": found["test"].rule, "digest": forest_digest(spark, path)}
    spark.createDataFrame([(json.dumps(report, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/report")
    return report


def forest_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 over the saved nodes of all trees, in any order of files."""
    nodes = spark.read.parquet(f"{path}/model/data")
    each = nodes.select(F.sha2(F.to_json(F.struct(*sorted(nodes.columns))), 256).alias("h"))
    sums = [F.sum(F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)")) for k in range(4)]
    return hashlib.sha256(":".join(str(x) for x in each.agg(F.count(F.lit(1)), *sums).first()).encode()).hexdigest()


def load_forest(spark: SparkSession, path: str):
    """A saved forest and its report; one of other features, or of trees that are not those of its report, is refused."""
    report = json.loads(spark.read.text(f"{path}/report").first().value)
    if report["feature_schema"] != FEATURE_SCHEMA:
        raise ValueError(f"features {report['feature_schema']} are not {FEATURE_SCHEMA}")
    if forest_digest(spark, path) != report["digest"]:
        raise ValueError("the saved trees are not those of the report")
    return RandomForestClassificationModel.load(f"{path}/model"), report


def applied_forest(model, rows: DataFrame) -> DataFrame:
    """rows with score, the probability of label 1, and predicted."""
    scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(rows))
    score = vector_to_array("probability")[1]
    return scored.select(*[f"`{c}`" for c in rows.columns], score.alias("score"), (score >= 0.5).cast("double").alias("predicted"))


def learned_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts with features, the label whether their order is finished, a split by customer, and the rule's verdict."""
    orders = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("attempt"), "o_custkey", (F.col("o_orderstatus") == "F").cast("double").alias("label"))
    rows = by_speaker(decision_rows(spark, sf_dir).join(orders, "attempt"), "o_custkey")
    return staged(rows.withColumn("rule", (F.col("min_score") > -0.35).cast("double")))


def random_forest(spark: SparkSession, sf_dir: str, trees: int = 40, depth: int = 8) -> DataFrame:
    """Probability that a held-out attempt is of a finished order, by a forest that is saved and loaded again."""
    g = learned_attempts(spark, sf_dir)
    path = hold(spark, f"{shared_dir(spark)}/forest-{uuid.uuid4().hex}")
    save_forest(g, path, "attempts-1", trees, depth)
    model, _ = load_forest(spark, path)
    return applied_forest(model, g.where("split = 'test'")).select("attempt", F.col("label").cast("int").alias("label"), "score")


def forest_report(spark: SparkSession, sf_dir: str, trees: int = 40, depth: int = 8) -> DataFrame:
    """The report of a forest, one row."""
    path = hold(spark, f"{shared_dir(spark)}/forest-{uuid.uuid4().hex}")
    r = save_forest(learned_attempts(spark, sf_dir), path, "attempts-1", trees, depth)
    names = ("train_count", "validation_count", "test_count", "validation_accuracy", "test_accuracy", "rule_test_accuracy", "model_version", "feature_schema", "digest")
    return spark.createDataFrame([tuple(r[n] for n in names)], "train_count long, validation_count long, test_count long, validation_accuracy double, test_accuracy double, rule_test_accuracy double, model_version string, feature_schema string, digest string")


def decision_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learning features of each attempt that has a scored phone."""
    g = _phones(spark, sf_dir).where("score > -20").groupBy("attempt")
    return g.agg(F.avg("score").alias("mean_score"), F.min("score").alias("min_score"), F.avg("confidence").alias("mean_confidence"), F.min("confidence").alias("min_confidence"))


QUERIES = {f.__name__: f for f in (best_variant, phones_to_words, label_runs, acoustic_confidence, cleaning_report, random_forest, forest_report)}
ORACLE_SQL = {
    "best_variant": _PH + "SELECT attempt, word, total FROM (SELECT attempt, word, round(sum(score) + 1e-8, 6) AS total FROM ph GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY attempt ORDER BY total DESC, word) = 1",
    "phones_to_words": """WITH li AS (SELECT l_orderkey AS attempt, l_linenumber, l_suppkey % 3 + 1 AS length FROM lineitem),
      t AS (SELECT attempt, l_linenumber AS token, sum(length) OVER (PARTITION BY attempt ORDER BY l_linenumber) AS stop, length FROM li)
      SELECT li.attempt, l_linenumber - 1 AS position, token FROM li JOIN t ON li.attempt = t.attempt AND l_linenumber - 1 >= stop - t.length AND l_linenumber - 1 < stop""",
    "label_runs": """WITH e AS (SELECT *, row_number() OVER w AS n, lag(event_type) OVER w AS last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      r AS (SELECT *, sum(CASE WHEN last IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY n) AS run FROM e)
      SELECT user_id AS session_id, CAST(run AS BIGINT) AS run, min(event_type) AS label, min(n) AS first_frame, max(n) AS last_frame FROM r GROUP BY 1, 2""",
    "acoustic_confidence": THRESHOLDS_SQL.format(step=0.05) + """SELECT recording_id, word, round(exp(-distance), 6) AS score,
      round(CASE WHEN distance <= accept THEN least(1.0, accept / greatest(distance, 1e-9)) WHEN distance >= reject THEN least(1.0, distance / reject - 1) ELSE abs(distance - (accept + reject) / 2) / (reject - accept) END, 6) AS confidence
      FROM dist JOIN th USING (candidate) WHERE word = candidate""",
}
