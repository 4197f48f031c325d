"""Real rows as representatives of groups of any size: farthest-first seeds, one pass of clusters.

Each round is an aggregate over all rows of all groups: the next seed of a group is its row with the
largest distance to the seeds there, and rows keep only their least distance and the seed it is from.
Groups of any size are spread over all tasks, and only seeds and centres, a few rows a group, go round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolark.core import broadcast_if_small, scratch, staged


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def centres(rows: DataFrame, keys: list[str], dims: int) -> DataFrame:
    """The mean point of each group of rows (keys, z)."""
    return staged(rows.groupBy(*keys).agg(F.array(*[F.avg(F.col("z")[k]) for k in range(dims)]).alias("centre")))


def nearest_rows(rows: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, z): of each group the row nearest to its point, of equal ones that of the least id."""
    d = rows.join(broadcast_if_small(points), keys).select(*keys, "id", "z", distance(F.col("z"), F.col("centre")).alias("d"))
    return d.groupBy(*keys).agg(F.min(F.struct("d", "id", "z")).alias("best")).select(*keys, "best.id", "best.z")


def spread_seeds(rows: DataFrame, counts: DataFrame, most: int, dims: int) -> tuple[DataFrame, DataFrame]:
    """Seeds (group, place, id, z) and rows with `near`, the place of the nearest seed, and `gap`, its distance.

    The first seed is nearest to the mean; each next one, until a group has its count, is farthest from
    those there. Rows nearest to two seeds alike go to the first."""
    seeds = staged(nearest_rows(rows, centres(rows, ["group"], dims), ["group"]).withColumn("place", F.lit(0)))
    held = rows.join(broadcast_if_small(seeds.select("group", F.col("z").alias("s"))), "group")
    held = staged(held.select("group", "id", "z", distance(F.col("z"), F.col("s")).alias("gap"), F.lit(0).alias("near")))
    for place in range(1, most):
        taken = seeds.groupBy("group").agg(F.collect_list("id").alias("taken")).join(counts.where(F.col("count") > place), "group")
        free = held.join(broadcast_if_small(staged(taken)), "group").where(~F.array_contains("taken", F.col("id")))
        last = free.groupBy("group").agg(F.min(F.struct((-F.col("gap")).alias("minus"), "id", "z")).alias("best"))
        last = staged(last.select("group", "best.id", "best.z", F.lit(place).alias("place")))
        if last.isEmpty():
            break
        seeds = staged(seeds.select("group", "id", "z", "place").union(last))
        d = distance(F.col("z"), F.col("s"))
        held = held.join(broadcast_if_small(last.select("group", F.col("z").alias("s"))), "group", "left")
        closer = F.coalesce(d < F.col("gap"), F.lit(False))
        held = staged(held.select("group", "id", "z", F.when(closer, d).otherwise(F.col("gap")).alias("gap"), F.when(closer, F.lit(place)).otherwise(F.col("near")).alias("near")))
    return seeds, held


def representatives(rows: DataFrame, counts: DataFrame, most: int, dims: int) -> DataFrame:
    """(group, place, id), staged: for each group of rows (group, id, z) as many rows as counts (group, count)
    tells, `most` at most: of each seed's cluster the row nearest to the cluster's mean. A cluster without
    rows, as only equal rows leave it, has its seed."""
    with scratch(rows.sparkSession):
        rows = staged(rows.select("group", "id", "z"))
        seeds, held = spread_seeds(rows, counts, most, dims)
        clusters = held.select("group", F.col("near").alias("place"), "id", "z")
        best = staged(nearest_rows(clusters, centres(clusters, ["group", "place"], dims), ["group", "place"]))
        found = seeds.select("group", "place", F.col("id").alias("seed")).join(best.select("group", "place", "id"), ["group", "place"], "left")
        return staged(found.select("group", "place", F.coalesce("id", "seed").alias("id")), keep=True)
