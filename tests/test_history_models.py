"""Histories of versions over builds and reruns, and saved forests."""

import pytest
from pyspark.sql import functions as F

from echolark.operators import history, learning

SCHEMA = "word string, version string, price double"


def test_builds_keep_ids_and_one_active_version(spark, tmp_path):
    kept = history.History(spark, str(tmp_path / "t"), ["word"], "version", ["price"], SCHEMA)
    build = lambda rows, k: kept.build(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA + ", n int"), "n", k)
    build([("a", "1", 1.0), ("b", "1", 2.0), (None, "1", 9.0), ("a", "0", 7.0)], 1)
    first = {r.word: r.id for r in kept.active().collect()}
    build([("a", "2", 3.0)], 2)
    build([("a", "1", 4.0), ("c", None, 5.0)], 3)
    rows = lambda: sorted((r.word, r.version or "", r.price, r.valid_from, r.valid_to) for r in kept.read().collect())
    want = sorted([("a", "1", 1.0, 1, 2), ("a", "2", 3.0, 2, 3), ("a", "1", 4.0, 3, None), ("b", "1", 2.0, 1, None), ("c", "", 5.0, 3, None)], key=str)
    assert sorted(rows(), key=str) == want
    assert {r.word: r.id for r in kept.active().where("word != 'c'").collect()} == first
    build([("a", "1", 4.0), ("c", None, 5.0)], 3)  # again
    assert sorted(rows(), key=str) == want
    build([("c", None, 6.0)], 3)  # again, with other rows: a's version 2 is open again
    assert ("a", "2", 3.0, 2, None) in rows() and ("c", "", 6.0, 3, None) in rows() and len(rows()) == 4
    build([], 4)
    assert len(rows()) == 4


def examples(spark, n=1500):
    r = spark.range(n).select((F.col("id") % 60).alias("speaker"), *[F.rand(k).alias(c) for k, c in enumerate(learning.FEATURES)])
    r = r.withColumns({"label": (F.col("mean_score") + F.col("min_score") > 1).cast("double"), "rule": (F.col("mean_score") > 0.5).cast("double")})
    return learning.by_speaker(r, "speaker").cache()


def test_a_forest_is_saved_checked_and_loaded(spark, tmp_path):
    rows, path = examples(spark), str(tmp_path)
    assert rows.groupBy("speaker").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    report = learning.save_forest(rows, path, "v1", 20, 6)
    assert report["train_count"] + report["validation_count"] + report["test_count"] == 1500
    assert report["test_accuracy"] > 0.85 > report["rule_test_accuracy"] > 0.5
    model, told = learning.load_forest(spark, path)
    assert told == report
    scored = learning.applied_forest(model, rows.where("split = 'test'"))
    assert scored.agg(F.avg((F.col("predicted") == F.col("label")).cast("double"))).first()[0] == pytest.approx(report["test_accuracy"])
    other = learning.save_forest(rows, str(tmp_path / "other"), "v1", 20, 6)
    assert other["digest"] == report["digest"]  # one seed, one forest
    spark.read.parquet(f"{tmp_path}/other/model/data").limit(5).write.mode("append").parquet(f"{path}/model/data")
    with pytest.raises(ValueError, match="not those of the report"):
        learning.load_forest(spark, path)


def test_few_rows_or_one_class_are_refused(spark, tmp_path):
    rows = examples(spark)
    with pytest.raises(ValueError, match="needs"):
        learning.save_forest(rows.limit(200), str(tmp_path), "v1")
    with pytest.raises(ValueError, match="two classes"):
        learning.save_forest(rows.withColumn("label", F.lit(1.0)), str(tmp_path), "v1")


def test_training_keeps_the_node_of_each_row(spark):
    model = learning.fit_forest(examples(spark), learning.FEATURES, "label", 3, 3)
    assert model.getCacheNodeIds()
