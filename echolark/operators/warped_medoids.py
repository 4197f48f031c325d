"""Medoids by warped distance among all rows of groups of any size.

A medoid is the row of its cluster with the least sum of warped distances to all rows there, so that at first every
row of a group and then every row of a cluster is compared with every other. One task settles a group of WHOLE rows at
most. Rows of a larger group are dealt into blocks by a hash, and pairs of blocks over all tasks: a task holds two
blocks, and of what it compares only a sum for each row goes on. The medoids themselves, COUNT rows a group, go
round with each pass. Distances are whole numbers of UNITs, so that sums are the same in any order; of equal ones,
the least id is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolark.core import broadcast_if_small, scratch, staged
from echolark.functions.signal import dtw_block, medoids
from echolark.plans.domain import MOST_WORDS

FRAME_DIMS = 4
COUNT, ROUNDS = 4, 8
#: Distances farther than 2 are of recordings with frames of zeros only; a block's sum of the farthest fits a long.
UNIT, FARTHEST = 2.0**-36, 2**14
#: Rows of a group that one task settles; rows of a block, and in the largest groups, as a row is sent once for each
#: block of its group; blocks from which on they grow; rows of a block compared at once; most tasks of a pass.
WHOLE, BLOCK, LARGE_BLOCK, SMALL, STRIP, MOST_TASKS = 2_048, 1_024, 8_192, 16, 256, 4_000

#: Rows as their ids and their values, a frame after the other.
Rows = tuple[np.ndarray, list[np.ndarray]]
#: The medoids of each group, by place: id and values.
Found = dict[int, list[tuple[int, list[float]]]]


def _by_length(values: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the values of one length, and these as (rows, frames, dims)."""
    lengths = np.array([len(x) for x in values])
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, np.stack([values[k] for k in at]).reshape(len(at), -1, FRAME_DIMS)


def block_distances(a: Rows, b: Rows) -> np.ndarray:
    """Distances of each row of a to each of b, in UNITs: the row of the lesser id is warped to the other."""
    out = np.empty((len(a[0]), len(b[0])), np.int64)
    others = list(_by_length(b[1]))
    for i, x in _by_length(a[1]):
        for j, y in others:
            d = dtw_block(x, y)
            if x.shape[1] != y.shape[1]:
                d = np.where(a[0][i][:, None] < b[0][j], d, dtw_block(y, x).T)
            if d.max() > FARTHEST:
                raise ValueError(f"a distance of more than {FARTHEST}")
            out[np.ix_(i, j)] = np.rint(d * (1 / UNIT))
    return out


def _part(rows: Rows, at: slice) -> Rows:
    return rows[0][at], rows[1][at]


def strips(a: Rows, b: Rows | None = None) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Distances of all pairs of a and b, or of a itself: some rows of a, rows of the other side from the first that
    was not met before on, and the distances."""
    for k in range(0, len(a[0]), STRIP):
        rows, others = slice(k, min(k + STRIP, len(a[0]))), slice(k if b is None else 0, len((b or a)[0]))
        yield rows, others, block_distances(_part(a, rows), _part(b or a, others))


def block_sums(a: Rows, b: Rows | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of a and of b, the sum of its distances to the other side; without b, of a to itself and of none."""
    sums, others = np.zeros(len(a[0]), np.int64), np.zeros(len(b[0]) if b else 0, np.int64)
    for rows, columns, d in strips(a, b):
        sums[rows] += d.sum(axis=1)
        if b:
            others += d.sum(axis=0)
        else:
            sums[rows.stop :] += d[:, rows.stop - rows.start :].sum(axis=0)
    return sums, others


def square(rows: Rows) -> np.ndarray:
    """All distances of rows."""
    out = np.zeros((len(rows[0]),) * 2, np.int64)
    for at, others, d in strips(rows):
        out[at, others] = d
        out[others, at] = d.T
    return out


def _rows(ids: pa.Array, values: pa.Array) -> Rows:
    if values.null_count:
        raise ValueError("a recording without values")
    ends = np.cumsum(values.value_lengths().to_numpy())
    return ids.to_numpy(), np.split(np.asarray(values.flatten(), float), ends[:-1]) if len(ends) else []


def totals(rows: DataFrame) -> DataFrame:
    """(group, part, id, total) of rows (group, part, id, embedding): a row's distances to all rows of its part of the
    group, summed."""
    n = F.count(F.lit(1))
    parts = staged(rows.groupBy("group", "part").agg(F.least(F.ceil(n / BLOCK), SMALL + F.ceil(n / LARGE_BLOCK)).cast("int").alias("blocks")))
    pairs = parts.agg(F.sum(F.col("blocks") * (F.col("blocks") + 1) / 2)).first()[0]
    block = F.pmod(F.xxhash64(F.lit("block"), "id"), "blocks").cast("int").alias("block")
    dealt = rows.join(broadcast_if_small(parts), ["group", "part"]).select("group", "part", "id", "embedding", "blocks", block)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    by = ["group", "part", "low", "high"]
    met = dealt.select("group", "part", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id", "embedding")
    schema = pa.schema([("group", pa.int32()), ("part", pa.int32()), ("id", pa.int64()), ("total", pa.int64())])

    def sums(key: tuple, t: pa.Table) -> pa.Table:
        group, part, low, high = (x.as_py() for x in key)
        t = t.sort_by("id").combine_chunks()
        block = t.column("block").to_numpy()
        sides = []
        for b in dict.fromkeys((low, high)):
            side = t.filter(pa.array(block == b)).combine_chunks()
            sides.append(_rows(side.column("id").combine_chunks(), side.column("embedding").combine_chunks()))
        found = np.concatenate(block_sums(*sides))
        ids = np.concatenate([ids for ids, _ in sides])
        return pa.table([np.full(len(ids), group, np.int32), np.full(len(ids), part, np.int32), ids, found], schema=schema)

    found = met.repartition(int(min(MOST_TASKS, 2 * pairs)), *by).groupBy(*by).applyInArrow(sums, "group int, part int, id long, total long")
    return found.groupBy("group", "part", "id").agg(F.sum("total").alias("total"))


def least_rows(rows: DataFrame) -> dict[tuple[int, int], tuple[int, list[float]]]:
    """Of each part of a group of rows (group, part, id, embedding) the row with the least total: id and values."""
    best = totals(rows).groupBy("group", "part").agg(F.min(F.struct("total", "id")).alias("best")).select("group", "part", "best.id")
    return {(r.group, r.part): (r.id, r.embedding) for r in rows.join(F.broadcast(staged(best)), ["group", "part", "id"]).collect()}


def placed(rows: DataFrame, found: Found) -> DataFrame:
    """Rows (group, id, embedding) of the groups of `found` with part, the place of the nearest medoid, of equal ones
    the first, and gap, the distance to it: -1 for medoids."""
    shared = rows.sparkSession.sparkContext.broadcast(found)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column(0).to_numpy()
            for g in np.unique(groups):
                if not (of := shared.value.get(g)):
                    continue
                b = batch.take(pa.array(np.flatnonzero(groups == g)))
                seeds = np.array([k for k, _ in of]), [np.asarray(x, float) for _, x in of]
                d = block_distances(_rows(b.column(1), b.column(2)), seeds)
                gap = np.where(np.isin(b.column(1).to_numpy(), seeds[0]), -1, d.min(axis=1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(d.argmin(axis=1).astype(np.int32)), pa.array(gap)], names=["group", "id", "embedding", "part", "gap"])

    return rows.select("group", "id", "embedding").mapInArrow(place, "group int, id long, embedding array<float>, part int, gap long")


def of_large(rows: DataFrame) -> Found:
    """What signal.medoids finds for each group of rows (group, id, embedding), without its matrix."""
    found = {g: [best] for (g, _), best in least_rows(rows.withColumn("part", F.lit(0))).items()}
    for _ in range(1, COUNT):
        far = placed(rows, found).groupBy("group").agg(F.min(F.struct((-F.col("gap")).alias("minus"), "id", "embedding")).alias("far"))
        for r in far.select("group", "far.*").collect():
            found[r.group].append((r.id, r.embedding))
    moving = dict(found)
    for _ in range(ROUNDS):
        best = least_rows(staged(placed(rows, moving).drop("gap")))
        new = {g: [best.get((g, k), old) for k, old in enumerate(of)] for g, of in moving.items()}
        moving = {g: of for g, of in new.items() if [k for k, _ in of] != [k for k, _ in moving[g]]}
        if not moving:
            break
        found |= moving
    return found


def warped_medoids(rows: DataFrame) -> DataFrame:
    """(word, proto_idx, recording_id, embedding), staged: up to COUNT medoids of each word's rows (word, recording_id,
    embedding)."""
    schema = "word string, proto_idx int, recording_id long, embedding array<float>"
    spark = rows.sparkSession

    def choose(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("recording_id").reset_index(drop=True)
        at = medoids(square((g.recording_id.to_numpy(), [np.asarray(x, float) for x in g.embedding])), COUNT, ROUNDS)
        return pd.DataFrame({"word": g.word.iloc[0], "proto_idx": range(len(at)), "recording_id": g.recording_id[at].to_numpy(), "embedding": [g.embedding[k] for k in at]})

    with scratch(spark):
        rows = staged(rows.select("word", F.col("recording_id").cast("long").alias("recording_id"), F.col("embedding").cast("array<float>").alias("embedding")))
        large = [r.word for r in rows.groupBy("word").count().where(F.col("count") > WHOLE).limit(MOST_WORDS + 1).collect()]
        if len(large) > MOST_WORDS:
            raise ValueError(f"more than {MOST_WORDS} words of more than {WHOLE} rows")
        if not large:
            return staged(rows.groupBy("word").applyInPandas(choose, schema), keep=True)
        names = spark.createDataFrame(list(enumerate(large)), "group int, name string")
        named = rows.join(F.broadcast(names), F.col("word").eqNullSafe(F.col("name")), "left")
        small = named.where(F.col("group").isNull()).select(*rows.columns).groupBy("word").applyInPandas(choose, schema)
        found = of_large(staged(named.where(F.col("group").isNotNull()).select("group", F.col("recording_id").alias("id"), "embedding")))
        told = [(large[g], k, i, list(x)) for g, of in found.items() for k, (i, x) in enumerate(of)]
        return staged(small.union(spark.createDataFrame(told, schema)), keep=True)
