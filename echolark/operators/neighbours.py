"""Exact nearest neighbours by cosine within groups, pruned by pivots and the triangle inequality.

Vectors are put in units of their group's means and deviations and cut to length one, where the cosine
orders as the distance does. Each group has up to PIVOTS pivots, rows taken by a hash of their ids (a bounded
sample; it decides what is pruned, never what is found). Rows belong to the cell of their nearest
pivot, and keep their distance to it. A query first meets the cell of its nearest pivot with enough
rows; the distance of the last wanted neighbour there bounds the search: a cell whose rows are all
farther from its pivot's side of the query than that is left out, and within a cell so is every row
whose distance to the pivot differs from the query's by more. What is left of a cell is compared in blocks, as
products of matrices; of a query and block only the best few rows go on, so that pairs are never shuffled.

Of equal vectors only the few rows that can be among the wanted ones are kept, and equal queries are
searched once, so very large groups of copies cost no pairs. Vectors without a direction (all values at
their group's mean) and values that are not finite are left out; equal similarities, to six places,
are ordered by id; a row is not its own neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echolark.core import broadcast_if_small, read_table, scratch, staged
from echolark.plans.domain import DIMS, REC_SQL, recordings

PIVOTS, MOST_GROUPS = 64, 1_000
#: Similarities that differ by less may be equal to six places.
SLACK = 1.5e-6
#: Rows and queries of a block, and of one product within it.
BLOCK, CHUNK, WIDTH = 32_768, 256, 4_096


def units(rows: DataFrame, of: DataFrame, dims: int) -> DataFrame:
    """rows (group, id, v) with u, the vector in units of its group in `of`, of length one."""
    at = lambda f: F.array(*[f(F.col("v")[k]) for k in range(dims)])
    scale = staged(of.groupBy("group").agg(at(F.avg).alias("mean"), at(F.stddev_pop).alias("sd")))
    j = rows.join(broadcast_if_small(scale, MOST_GROUPS), "group")
    z = F.transform(F.arrays_zip("v", "mean", "sd"), lambda x: (x["v"] - x["mean"]) / F.when(x["sd"] > 0, x["sd"]).otherwise(1.0))
    j = j.select("group", "id", z.alias("z")).withColumn("size", F.sqrt(F.aggregate("z", F.lit(0.0), lambda s, x: s + x * x)))
    fine = (F.col("size") > 0) & (F.col("size") < float("inf"))
    return j.where(fine).select("group", "id", F.transform("z", lambda x: x / F.col("size")).alias("u"))


def pivots_of(rows: DataFrame) -> dict[str, np.ndarray]:
    """Up to PIVOTS rows of each group, those of the least hashes."""
    sizes = broadcast_if_small(staged(rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"))))
    h = F.xxhash64(F.lit("pivot"), "id")
    # first a part that surely has enough of the least, so that no group is ranked whole
    some = rows.withColumn("h", h).join(sizes, "group").where((F.col("h") / F.lit(2.0**64) + 0.5) * F.col("n") <= 4 * PIVOTS)
    some = some.withColumn("k", F.row_number().over(Window.partitionBy("group").orderBy("h", "id"))).where(F.col("k") <= PIVOTS)
    found: dict[str, list] = {}
    for r in some.select("group", "u").collect():
        found.setdefault(r.group, []).append(r.u)
        if len(found) > MOST_GROUPS:
            raise ValueError(f"more than {MOST_GROUPS} groups")
    return {g: np.array(u) for g, u in found.items()}


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def to_pivots(u: np.ndarray, groups: list[str], pivots: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the rows of each group that has pivots, and their distances to these."""
    names = np.array(groups, object)
    for g in set(groups) & set(pivots):
        at = np.flatnonzero(names == g)
        yield at, np.sqrt(np.maximum(0, 2 - 2 * u[at] @ pivots[g].T))


def with_cells(rows: DataFrame, pivots: dict[str, np.ndarray]) -> DataFrame:
    """rows (group, id, u) with cell, the place of the nearest pivot, and away, the distance to it."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, cell, away = _matrix(b.column(2)), np.full(b.num_rows, -1), np.full(b.num_rows, np.nan)
            for at, d in to_pivots(u, b.column(0).to_pylist(), shared.value):
                cell[at], away[at] = d.argmin(axis=1), d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(away)], names=["group", "id", "u", "cell", "away"])

    return rows.select("group", "id", "u").mapInArrow(place, "group string, id long, u array<double>, cell int, away double")


def cells_to_search(queries: DataFrame, cells: DataFrame, pivots: dict[str, np.ndarray], wanted: int) -> DataFrame:
    """(group, id, u, bound, cell, away) of queries (group, id, u, bound): without a bound, the nearest cell that
    has `wanted` rows (or all cells, if none has); with one, all cells that may hold a row within it, but for that."""
    held: dict[str, list] = {}
    for r in cells.collect():  # PIVOTS a group at most
        held.setdefault(r.group, []).append((r.cell, r.n, r.least, r.most))
    shared = queries.sparkSession.sparkContext.broadcast((pivots, held))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, held = shared.value
        for b in batches:
            u, bound = _matrix(b.column(2)), np.asarray(b.column(3).fill_null(np.nan), float)
            row, cell, away = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)]
            groups = b.column(0).to_pylist()
            for at, d in to_pivots(u, groups, pivots):
                if not (of := held.get(groups[at[0]])):
                    continue
                places, n, least, most = (np.array(x) for x in zip(*of, strict=True))
                d = d[:, places]
                enough = n >= wanted
                first = np.where(enough, d, np.inf).argmin(axis=1)[:, None] == np.arange(len(places)) if enough.any() else np.ones(d.shape, bool)
                limit = bound[at][:, None]
                near = (d - limit <= most) & (d + limit >= least) & ~first
                i, k = np.nonzero(np.where(np.isnan(limit), first, near))
                row.append(at[i]), cell.append(places[k]), away.append(d[i, k])
            rows = b.take(pa.array(np.concatenate(row)))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.concatenate(cell).astype(np.int32)), pa.array(np.concatenate(away))], names=["group", "id", "u", "bound", "cell", "away"])

    return queries.select("group", "id", "u", "bound").mapInArrow(search, "group string, id long, u array<double>, bound double, cell int, away double")


def left(searched: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs of queries and rows of their cells that the triangle inequality leaves."""
    x = rows.select("group", "cell", F.col("away").alias("off"))
    return searched.join(x, ["group", "cell"]).where(F.col("bound").isNull() | (F.abs(F.col("off") - F.col("away")) <= F.col("bound")))


def rounded(x: np.ndarray) -> np.ndarray:
    """To six places, halves away from zero."""
    return np.copysign(np.floor(np.abs(x) * 1e6 + 0.5) / 1e6, x)


def best_of_block(q: np.ndarray, bound: np.ndarray, away: np.ndarray, w: np.ndarray, ids: np.ndarray, off: np.ndarray, wanted: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of queries q and rows w with their similarity: of each query the best `wanted` rows at most, those within
    its bound if it has one. Both are ordered by their distance to the pivot, so that a run of queries meets one
    range of the rows; products of a run are taken at once, and those that may be wanted again one by one."""
    least = np.where(np.isnan(bound), -np.inf, 1 - bound * bound / 2 - SLACK)
    for k in range(0, len(q), CHUNK):
        run, reach = slice(k, k + CHUNK), np.where(np.isnan(bound[k : k + CHUNK]), np.inf, bound[k : k + CHUNK] + SLACK)
        low = np.searchsorted(off, (away[run] - reach).min(), "left")
        high = np.searchsorted(off, (away[run] + reach).max(), "right")
        for m in range(low, high, WIDTH):
            near = slice(m, min(m + WIDTH, high))
            s, limit = q[run] @ w[near].T, least[run].copy()
            full = np.flatnonzero((s >= limit[:, None]).sum(axis=1) > wanted)
            if len(full):
                limit[full] = np.maximum(limit[full], np.partition(s[full], -wanted, axis=1)[:, -wanted] - SLACK)
            i, j = np.nonzero(s >= limit[:, None])
            found = np.zeros(len(i))
            for x, y in zip(q[run][i].T, w[near][j].T, strict=True):
                found += x * y
            found = rounded(found)
            order = np.lexsort((ids[near][j], -found, i))
            i, j, found = i[order], j[order], found[order]
            first = np.searchsorted(i, i, "left")
            keep = np.arange(len(i)) - first < wanted
            yield k + i[keep], m + j[keep], found[keep]


def met(searched: DataFrame, rows: DataFrame, cells: DataFrame, wanted: int) -> DataFrame:
    """(query, id, similarity) of queries and rows of their cells, block by block: of each query and block the best
    `wanted` rows. Cells of many rows or many queries are dealt over several blocks."""
    searched = staged(searched)
    asked = searched.groupBy("group", "cell").agg(F.count(F.lit(1)).alias("asked"))
    parts = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    dealt = broadcast_if_small(staged(cells.join(asked, ["group", "cell"]).select("group", "cell", parts("n").alias("row_parts"), parts("asked").alias("query_parts"))))
    part = lambda n: F.pmod(F.xxhash64(F.lit("block"), "id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = searched.join(dealt, ["group", "cell"]).select("group", "cell", every("row_parts").alias("r"), part("query_parts").alias("q"), "id", "u", "bound", "away")
    right = rows.join(dealt, ["group", "cell"]).select("group", "cell", part("row_parts").alias("r"), every("query_parts").alias("q"), "id", "u", "away")
    schema = pa.schema([("query", pa.int64()), ("id", pa.int64()), ("similarity", pa.float64())])

    def block(a: pa.Table, b: pa.Table) -> pa.Table:
        if not (a.num_rows and b.num_rows):
            return schema.empty_table()
        a, b = a.sort_by("away").combine_chunks(), b.sort_by("away").combine_chunks()
        at = lambda t, c: t.column(c).combine_chunks()
        q, w, ids = _matrix(at(a, "u")), _matrix(at(b, "u")), at(b, "id").to_numpy()
        bound, away = np.asarray(at(a, "bound").fill_null(np.nan), float), at(a, "away").to_numpy()
        found = list(best_of_block(q, bound, away, w, ids, at(b, "away").to_numpy(), wanted))
        if not found:
            return schema.empty_table()
        i, j, s = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table([at(a, "id").to_numpy()[i], ids[j], s], schema=schema)

    by = ["group", "cell", "r", "q"]
    return left.groupBy(by).cogroup(right.groupBy(by)).applyInArrow(block, "query long, id long, similarity double")


def firsts(found: DataFrame, wanted: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= wanted)


def nearest(rows: DataFrame, queries: DataFrame, k: int, told: list | None = None) -> DataFrame:
    """(query, rank, id, similarity), staged: the k rows (group, id, u) nearest to each query (group, id, u) of its
    group. `told` gets the numbers of pairs that the triangle inequality left."""
    with scratch(rows.sparkSession):
        # one more than wanted, as a query may be a row itself
        wanted = k + 1
        copy = Window.partitionBy("group", "u").orderBy("id")
        rows = rows.withColumn("copy", F.row_number().over(copy)).where(F.col("copy") <= wanted).select("group", "id", "u")
        rows = staged(rows)
        pivots = pivots_of(rows)
        rows = staged(with_cells(rows, pivots))
        cells = rows.groupBy("group", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("away").alias("least"), F.max("away").alias("most"))
        queries = staged(queries.select("group", "id", "u"))
        classes = staged(queries.groupBy("group", "u").agg(F.min("id").alias("class")))
        asked = classes.select("group", F.col("class").alias("id"), "u").withColumn("bound", F.lit(None).cast("double"))
        cells = staged(cells)
        searched = cells_to_search(asked, cells, pivots, wanted)
        first = staged(firsts(met(searched, rows, cells, wanted), wanted))
        last = first.groupBy("query").agg(F.min("similarity").alias("last"), F.count(F.lit(1)).alias("n")).where(F.col("n") == wanted)
        bound = F.sqrt(2 - 2 * F.col("last") + 2 * SLACK)
        again = asked.drop("bound").join(last.select(F.col("query").alias("id"), bound.alias("bound")), "id").select("group", "id", "u", "bound")
        further = cells_to_search(again, cells, pivots, wanted)
        more = met(further, rows, cells, wanted)
        if told is not None:
            told += [left(searched, rows).count(), left(further, rows).count()]
        best = staged(firsts(first.drop("rank").union(more), wanted))
        members = queries.join(classes, ["group", "u"]).select(F.col("id").alias("member"), F.col("class").alias("query"))
        found = members.join(best.drop("rank"), "query").where(F.col("id") != F.col("member"))
        return staged(firsts(found.select(F.col("member").alias("query"), "id", "similarity"), k).select("query", F.col("rank").cast("long").alias("rank"), "id", "similarity"), keep=True)


def knn_by_locale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three training recordings nearest to each validation recording among those of its locale, by cosine of
    features in units of the locale's training rows."""
    of = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("recording_id"), F.element_at(F.array(*map(F.lit, ("en-US", "es-ES", "fr-FR"))), (F.col("label") % 3 + 1).cast("int")).alias("group"))
    recs = recordings(spark, sf_dir).join(of, "recording_id").select("group", F.col("recording_id").alias("id"), F.col("feature").alias("v"), "split")
    train = recs.where("split = 'train'")
    rows, queries = units(train, train, DIMS), units(recs.where("split = 'validation'"), train, DIMS)
    return nearest(rows, queries, 3).select(F.col("query").alias("query_id"), F.col("id").alias("recording_id"), "similarity", "rank")


QUERIES = {"knn_by_locale": knn_by_locale}
ORACLE_SQL = {
    "knn_by_locale": REC_SQL + """, loc AS (SELECT l.*, ['en-US', 'es-ES', 'fr-FR'][e.label % 3 + 1] AS locale FROM lng l JOIN embeddings e ON e.vec_id = l.recording_id),
      m AS (SELECT locale, d, avg(x) AS mean, stddev_pop(x) AS sd FROM loc WHERE split = 'train' GROUP BY 1, 2),
      z AS (SELECT recording_id, locale, any_value(split) AS split, list((x - mean) / CASE WHEN sd > 0 THEN sd ELSE 1.0 END ORDER BY d) AS z FROM loc JOIN m USING (locale, d) GROUP BY 1, 2),
      p AS (SELECT q.recording_id AS query_id, r.recording_id, round(list_cosine_similarity(r.z, q.z), 6) AS similarity FROM z r JOIN z q ON r.locale = q.locale AND r.recording_id <> q.recording_id WHERE r.split = 'train' AND q.split = 'validation')
      SELECT query_id, recording_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, recording_id) AS rank FROM p QUALIFY rank <= 3""",
}
