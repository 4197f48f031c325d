"""Mixing: the cut in the order of finish times, slices, and targets against SQL."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from echolark.llm import mixing


@pytest.mark.parametrize("budget", [0, 1, 37, 500, 10_000])
def test_the_cut_is_where_the_sorted_words_reach_the_budget(spark, budget):
    rng = random.Random(budget)
    rows = [(rng.randrange(20), rng.randrange(4), place, rng.randint(1, 9), round(rng.random() * 2, 2)) for place in range(300)]
    taken, left = {}, budget
    for row, _, _, words, _ in sorted(rows, key=lambda r: (r[4], r[1], r[2])):
        part = min(words, left)
        left -= part
        if part:
            taken[row] = taken.get(row, 0) + part
    cut = spark.createDataFrame(rows, "row long, rank int, place long, words long, finish double")
    found = {r.row: r.taken for r in mixing.until_budget(cut, budget, 17).collect() if r.taken}
    assert found == taken


def test_slices_cover_each_pass_and_finish_in_order(spark):
    queue = spark.createDataFrame([(1, 0, 10, 35, 80.0, 0), (2, 0, 25, 35, 80.0, 10), (3, 1, 50, 50, 20.0, 0)], "row long, rank int, size long, source_size long, target double, start long")
    rows = mixing.slices(queue, 2, 3).collect()
    for row, size, passes in ((1, 10, 3), (2, 25, 3), (3, 50, 1)):
        own = sorted((r for r in rows if r.row == row), key=lambda r: r.place)
        assert sum(r.words for r in own) == size * passes and [r.finish for r in own] == sorted(r.finish for r in own)
    assert all(abs(r.finish - (r.place - 0.5) / (80 if r.rank == 0 else 20)) < 1e-12 for r in rows)


def test_targets_are_those_of_sql_and_are_met(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    goal = {s: (n, t) for s, n, t in con.sql(mixing.OP10_TARGETS_SQL).fetchall()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = mixing.op10_source_mixing(spark, sf_dir).join(docs.select("doc_id", "source"), "doc_id")
    sums = out.groupBy("source").agg(F.max("source_size").alias("n"), F.max("target").alias("t"), F.sum("taken").alias("taken"), F.max(F.col("taken") > 3 * F.col("size")).alias("over")).collect()
    assert {r.source for r in sums} == set(goal)
    for r in sums:
        assert r.n == goal[r.source][0] and r.t == pytest.approx(goal[r.source][1]) and abs(r.taken - r.t) <= 2 and not r.over


def test_a_hot_source_and_shared_ids(spark):
    rows = [(None if k % 3 == 0 else k // 4, "hot" if k % 3 else f"s{k % 7}", k % 11) for k in range(3_000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    out = mixing.mix_sources(df).toPandas()
    per = out.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert len(out) == len(rows) and out.taken.sum() == sum(r[2] for r in rows) and ((per.taken - per.target).abs() <= 3).all()
