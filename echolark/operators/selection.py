"""Exact quantiles by counting: no buffer of a key's values, no window over them.

A quantile lies between two ranks. For each key the range of values that holds a rank is narrowed in
rounds: values of the range are counted in BINS bins of equal width, which are combined before the
shuffle, and the bin that the rank falls into becomes the range, from its least to its largest value. A
range of FEW values or less, or of one value, needs no more rounds; its values are put in order in one
bounded list. Rounds are few: each cuts a range to a BINS-th, so values spread over many orders of
magnitude take the most, and every round takes at least one different value off.

Values that are null or not finite are left out, and keys without others have no row; equal values count
each; null keys are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echolark.core import broadcast_if_small, scratch, staged

BINS, FEW = 1024, 65_536


def _narrowed(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """ranges (key, rank, low, high, before, n) cut down to the bin of each rank."""
    inside = rows.join(broadcast_if_small(ranges), "key").where(F.col("value").between(F.col("low"), F.col("high")))
    # halves are subtracted, as the width of a range may be beyond the largest number
    place = (F.col("value") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
    bin_ = F.least(F.floor(place * BINS), F.lit(BINS - 1))
    counts = inside.groupBy("key", "rank", "before", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    upto = F.sum("n").over(Window.partitionBy("key", "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.withColumn("before", F.col("before") + upto - F.col("n"))
    return counts.where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n"))).select("key", "rank", "low", "high", "before", "n")


def ranked_values(rows: DataFrame, ranges: DataFrame, few: int = FEW) -> DataFrame:
    """(key, rank, found) for ranges (key, rank, low, high, before, n) of rows (key, value), both staged: the
    value with so many before it."""
    open_, settled = ranges, None
    while True:
        wide = (F.col("low") < F.col("high")) & (F.col("n") > few)
        done = open_.where(~wide)
        settled = done if settled is None else settled.union(done)
        open_ = open_.where(wide)
        if open_.isEmpty():
            break
        open_ = staged(_narrowed(rows, open_))
    one = settled.where("low = high").select("key", "rank", F.col("low").alias("found"))
    some = settled.where("low < high")
    # the ranks of a range share its list
    lists = rows.join(broadcast_if_small(some.groupBy("key", "low", "high", "before").agg(F.collect_set("rank").alias("ranks"))), "key")
    lists = lists.where(F.col("value").between(F.col("low"), F.col("high"))).groupBy("key", "low", "high", "before", "ranks").agg(F.sort_array(F.collect_list("value")).alias("held"))
    picked = lists.select("key", F.explode("ranks").alias("rank"), "before", "held")
    return one.union(picked.select("key", "rank", F.get("held", (F.col("rank") - F.col("before")).cast("int")).alias("found")))


def _between(low, high, part):
    return low + (high - low) * part


def exact_quantiles(rows: DataFrame, key: str, value: str, shares: dict[str, float], few: int = FEW) -> DataFrame:
    """(key, one column for each share): quantiles with linear interpolation of rows, which are read several
    times. Where no key has more than `few` values, each key's are put in order in one list at once."""
    v = F.col(value).cast("double")
    rows = rows.where(F.col(key).isNotNull() & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).select(F.col(key).alias("key"), v.alias("value"))
    place = {name: F.lit(float(p)) * (F.col("n") - 1) for name, p in shares.items()}
    about = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    if (about.agg(F.max("n")).first()[0] or 0) <= few:
        g = rows.groupBy("key").agg(F.sort_array(F.collect_list("value")).alias("held"), F.count(F.lit(1)).alias("n"))
        at = lambda r: F.get("held", r.cast("int"))
        return g.select(F.col("key").alias(key), *[_between(at(F.floor(p)), at(F.ceil(p)), p - F.floor(p)).alias(k) for k, p in place.items()])
    with scratch(rows.sparkSession):
        rows, about = staged(rows), staged(about)
        ranks = F.array_distinct(F.array(*[f(p).cast("long") for p in place.values() for f in (F.floor, F.ceil)]))
        ranges = about.select("key", F.explode(ranks).alias("rank"), "low", "high", F.lit(0).cast("long").alias("before"), "n")
        found = ranked_values(rows, ranges, few).join(about.select("key", "n"), "key")
        at = lambda r: F.max(F.when(F.col("rank") == r.cast("long"), F.col("found")))
        outs = [x.alias(f"{k}_{side}") for k, p in place.items() for side, x in (("low", at(F.floor(p))), ("high", at(F.ceil(p))), ("part", F.max(p - F.floor(p))))]
        g = found.groupBy("key").agg(*outs)
        return staged(g.select(F.col("key").alias(key), *[_between(F.col(f"{k}_low"), F.col(f"{k}_high"), F.col(f"{k}_part")).alias(k) for k in shares]), keep=True)


def largest_within(rows: DataFrame, allowed) -> tuple[float, int, int] | None:
    """The least value down to which the sum of weights, from the largest value on, is still allowed, with the number and
    the weight of the rows from there on; none if not even the largest is. rows (value, weight) are read in
    rounds, of which BINS sums each come to the driver; allowed(sum) must not hold again once it fails."""
    low, high = rows.agg(F.min("value"), F.max("value")).first()
    n = weight = 0
    best = None
    while low is not None:
        width = F.lit(high) / 2 - F.lit(low) / 2
        place = F.when(width > 0, (F.col("value") / 2 - F.lit(low) / 2) / width).otherwise(0.0)
        bins = rows.where(F.col("value").between(low, high)).groupBy(F.least(F.floor(place * BINS), F.lit(BINS - 1)).alias("bin"))
        found = bins.agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"), F.min("value").alias("low"), F.max("value").alias("high")).collect()
        low = None
        for r in sorted(found, key=lambda r: -r.bin):
            if allowed(weight + r.weight):
                n, weight = n + r.n, weight + r.weight
                best = (r.low, n, weight)
                continue
            if r.low < r.high:
                low, high = r.low, r.high
            break
    return best
