"""Pruned nearest neighbours against all pairs."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from echolark.operators import neighbours, scoring


def all_pairs(rows, queries, k):
    out = {}
    for g, q, u in queries:
        near = sorted((-round(float(np.dot(u, w)), 6), i) for h, i, w in rows if h == g and i != q)
        out[q] = [(i, -s) for s, i in near[:k]]
    return {q: v for q, v in out.items() if v}


def clustered(rng, n, groups, dims=8, first=0):
    centres = rng.normal(size=(12, dims)) * 3
    out = []
    for k in range(n):
        v = centres[rng.integers(12)] + rng.normal(size=dims) * 0.4
        out.append((groups[k % len(groups)], first + k, (v / np.linalg.norm(v)).tolist()))
    return out


def test_pruned_search_finds_what_all_pairs_give(spark):
    rng = np.random.default_rng(5)
    rows = clustered(rng, 1500, ["a", "b"])
    rows += [("a", 5000 + k, rows[0][2]) for k in range(300)]  # copies
    rows += [("few", 7000, rows[0][2]), ("few", 7001, rows[2][2])]
    queries = [rows[k] for k in range(0, 60, 3)] + clustered(rng, 40, ["a", "b"], first=9000) + [("a", 9500 + k, rows[0][2]) for k in range(50)] + [("few", 9900, rows[4][2]), ("none", 9901, rows[4][2])]
    told = []
    schema = "group string, id long, u array<double>"
    out = neighbours.nearest(spark.createDataFrame(rows, schema).repartition(4), spark.createDataFrame(queries, schema), 3, told)
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r.query, r.rank)):
        got.setdefault(r.query, []).append((r.id, r.similarity))
    assert got == all_pairs(rows, queries, 3)
    assert sum(told) < 0.3 * len({(g, tuple(u)) for g, _, u in queries}) * len(rows) / 2
    assert neighbours.nearest(spark.createDataFrame([], schema), spark.createDataFrame(queries, schema), 3).count() == 0


def test_vectors_without_direction_or_finite_values_are_left_out(spark):
    rows = [("a", 1, [1.0, 2.0]), ("a", 2, [3.0, 2.0]), ("a", 3, [2.0, 2.0]), ("b", 4, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "group string, id long, v array<double>")
    got = {r.id: r.u for r in neighbours.units(df, df, 2).collect()}
    assert got == {1: [-1.0, 0.0], 2: [1.0, 0.0]}
    odd = spark.createDataFrame([("a", 9, [float("nan"), 1.0]), ("a", 10, [float("inf"), 1.0]), ("zz", 11, [1.0, 1.0])], "group string, id long, v array<double>")
    assert neighbours.units(odd, df, 2).count() == 0


def test_pairs_stay_in_their_blocks(spark):
    rng = np.random.default_rng(7)
    rows = clustered(rng, 900, ["a"])
    schema = "group string, id long, u array<double>"
    pivots = {"a": np.array([rows[0][2]])}
    cells = neighbours.with_cells(spark.createDataFrame(rows, schema), pivots)
    sizes = cells.groupBy("group", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("away").alias("least"), F.max("away").alias("most"))
    asked = spark.createDataFrame([(g, 5000 + i, u) for g, i, u in rows[:200]], schema).withColumn("bound", F.lit(None).cast("double"))
    found = neighbours.met(neighbours.cells_to_search(asked, sizes, pivots, 4), cells, sizes, 4)
    # one cell of 900 rows: four rows a query go on, not 900
    assert found.groupBy("query").count().where("count <> 4").count() == 0 and found.count() == 800


def test_blocks_keep_ties_by_id_and_bounds():
    rng = np.random.default_rng(3)
    w = np.array([u for _, _, u in clustered(rng, 6000, ["a"])])
    w[100:130] = w[7]
    off = np.sort(rng.random(6000))
    q, ids = w[[7, 500, 900]], rng.permutation(6000)
    got = {}
    for i, j, s in neighbours.best_of_block(q, np.full(3, np.nan), np.zeros(3), w, ids, off, 4):
        for a, b, c in zip(i.tolist(), j.tolist(), s.tolist(), strict=True):
            got.setdefault(a, []).append((-c, ids[b]))
    for k in range(3):
        assert sorted(got[k])[:4] == sorted((-round(float(x), 6), i) for x, i in zip(w @ q[k], ids, strict=True))[:4]


def test_cosines_without_a_value_rank_as_in_sql(spark, tmp_path):
    rng = np.random.default_rng(11)
    for name, odd in (("odd", {5: [0.0] * 26, 40: [float("nan")] * 26, 200: None, 7: [0.0] * 26, 108: [0.0] * 26}), ("missing", {5: None, 6: None, 7: None, 108: None})):
        rows = [(k, odd[k] if k in odd else rng.normal(size=26).tolist(), k % 3) for k in range(400)]
        folder = tmp_path / name
        spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
        duckdb.sql(f"create or replace view embeddings as from '{folder}/embeddings.parquet/*.parquet'")
        key = lambda r: (r[0], r[3], r[1], str(r[2]))
        want = sorted((key(r) for r in duckdb.sql(scoring.ORACLE_SQL["knn_cosine"]).fetchall()), key=str)
        assert sorted((key((r.query_id, r.recording_id, r.similarity, r.rank)) for r in scoring.knn_cosine(spark, str(folder)).collect()), key=str) == want
