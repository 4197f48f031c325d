"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every source is a queue of shuffled documents, served at most `max_epochs` times over, in proportion
to its target. A document's virtual finish time is the running number of its source's words, over all
passes, divided by the source's target. All documents of all queues are sorted by that time, their
words are summed in that order, and the mix ends where the total budget is used up: that place, and
nothing else, decides what is taken. So that a source's last document does not overshoot, documents
are served in slices of a SLICES-th of their source's target at most (of one word, for small targets);
the slice in service at the end is taken in part, so the mix holds the budget to the word, and each
source its target to a slice or so. A document can thus be taken in part.

Nothing passes one task whole: documents are dealt into about sqrt(rows) ranges of their shuffle key,
and slices into as many ranges of their finish time. Ranges are summed first; only their sums, and
the slices of the one range in which the budget ends, are put in order by a window.

Defined cases: null or empty texts have size 0 and take nothing; a null source is a source of its
own, ordered last; repeated rows are documents of their own; equal shuffle keys are ordered by id
and size, equal finish times by source and place; if all sizes are 0 every target is 0; texts of any
length count whole; other columns pass through `mixed_documents`, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echolark.core import broadcast_if_small, field, own_columns, scratch, staged

WORD = r"[^\x20\x09-\x0D]++"
WORD_END = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"
BROADCAST_SOURCES = 20_000
#: Slices of a source's target, and of all targets together (16 of each at least).
SLICES, SLICES_IN_ALL = 16_384, 1 << 20


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    return F.array_join(F.slice(F.split(text, WORD_END), F.lit(1), n.cast("int")), "")


def source_targets(sized: DataFrame, weights: Sequence[float], budget: float | None, max_epochs: int) -> DataFrame:
    """source, source_size, n, target: water-filling of the budget by weight, capped at max_epochs times the size.

    In order of cap over weight, capped sources come first; the level that the rest share by weight
    is the largest of (budget - caps so far) / (weights left). One row per source passes one task.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = totals.withColumn("rank", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.lit(max_epochs) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    whole = Window.partitionBy(F.lit(0))
    asked = F.sum("source_size").over(whole) if budget is None else F.lit(budget)
    left = asked - (F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
    level = F.max(left / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))).over(whole)
    return ranked.select("source", "rank", "source_size", "n", F.least(F.col("cap").cast("double"), F.col("weight") * level).alias("target"))


def queued(rows: DataFrame, sources: DataFrame, ranges: int) -> DataFrame:
    """rows (row, doc_id, source, size, key) of size > 0 and of a source with a target, with the words
    of their source before them in the order of their keys."""
    of_source = broadcast_if_small(sources.where("target > 0").select(F.col("source").alias("name"), "rank", "source_size", "target"), BROADCAST_SOURCES)
    dealt = rows.where("size > 0").join(of_source, F.col("source").eqNullSafe(F.col("name"))).drop("name", "source")
    dealt = dealt.withColumn("dealt", F.least(F.floor((F.col("key") / F.lit(2.0**64) + 0.5) * ranges), F.lit(ranges - 1)).cast("int"))
    sums = dealt.groupBy("rank", "dealt").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("rank").orderBy("dealt").rowsBetween(Window.unboundedPreceding, -1)
    sums = staged(sums.select("rank", "dealt", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before")))
    within = Window.partitionBy("rank", "dealt").orderBy("key", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("before") + F.sum("size").over(within) - F.col("size")
    return dealt.join(sums, ["rank", "dealt"]).select("row", "rank", "size", "source_size", "target", start.alias("start"))


def slices(queue: DataFrame, kinds: int, max_epochs: int) -> DataFrame:
    """(row, rank, place, words, finish) of every slice: place and finish time are of its last word,
    the time less half a slice of its source, so that all sources are rounded alike. Passes that
    would begin behind the target are left out."""
    most = max(16, min(SLICES, SLICES_IN_ALL // max(1, kinds)))
    passes = F.least(F.lit(max_epochs), F.floor(F.col("target") / F.col("source_size")) + 1).cast("int")
    unit = F.ceil(F.col("target") / most).cast("long")
    served = queue.withColumn("unit", unit).withColumn("begin", F.explode(F.transform(F.sequence(F.lit(0), passes - 1), lambda k: k * F.col("source_size") + F.col("start"))))
    cut = served.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.col("unit"))))
    words = F.least(F.col("unit"), F.col("size") - F.col("from"))
    cut = cut.select("row", "rank", "target", "unit", words.alias("words"), (F.col("begin") + F.col("from") + words).alias("place"))
    return cut.select("row", "rank", "place", "words", ((F.col("place") - F.col("unit") / 2) / F.col("target")).alias("finish"))


def until_budget(cut: DataFrame, budget: int, ranges: int) -> DataFrame:
    """(row, taken): the words of the slices that come before the budget's end in the order of finish."""
    at = staged(cut.withColumn("dealt", F.floor(F.col("finish") * ranges)))
    sums = at.groupBy("dealt").agg(F.sum("words").alias("words"))
    upto = F.sum("words").over(Window.orderBy("dealt").rowsBetween(Window.unboundedPreceding, 0))
    sums = staged(sums.withColumn("upto", upto))
    last = sums.where(F.col("upto") >= budget).agg(F.min(F.struct("dealt", (F.col("upto") - F.col("words")).alias("before"))).alias("at")).first().at
    if last is None:
        taken = at.select("row", "words")
    else:
        running = F.sum("words").over(Window.partitionBy("dealt").orderBy("finish", "rank", "place").rowsBetween(Window.unboundedPreceding, 0))
        ending = at.where(F.col("dealt") == last.dealt).withColumn("left", budget - last.before - running + F.col("words"))
        ending = ending.where("left > 0").select("row", F.least("words", "left").alias("words"))
        taken = at.where(F.col("dealt") < last.dealt).select("row", "words").union(ending)
    return taken.groupBy("row").agg(F.sum("words").alias("taken"))


def _served(df: DataFrame, weights: Sequence[float] = (5, 2, 1), budget: float | None = None, max_epochs: int = 3, seed: int = 7, doc_id: str = "doc_id") -> DataFrame:
    """(doc, row, size, source_size, target, taken) of df, its columns as the struct doc."""
    tie = [df["tie"]] if "tie" in df.columns else []
    key = F.xxhash64(F.lit(seed), df[f"`{doc_id}`"], *tie)
    rows = staged(df.select(own_columns(df), F.monotonically_increasing_id().alias("row"), df[f"`{doc_id}`"].alias("doc_id"), df["source"].alias("source"), df["size"].alias("size"), key.alias("key")))
    with scratch(df.sparkSession):
        sources = staged(source_targets(rows, weights, budget, max_epochs), keep=True)
        n, kinds, asked = sources.agg(F.sum("n"), F.count(F.lit(1)), F.sum("target")).first()
        ranges = max(1, isqrt(n or 0))
        queue = queued(rows.drop("doc"), sources, ranges)
        taken = staged(until_budget(slices(queue, kinds, max_epochs), round(asked or 0), ranges), keep=True)
    of_source = broadcast_if_small(sources.select(F.col("source").alias("name"), "source_size", "target"), BROADCAST_SOURCES)
    named = rows.select("doc", "row", "source", "size").join(of_source, F.col("source").eqNullSafe(F.col("name"))).drop("name", "source")
    return named.join(broadcast_if_small(taken), "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))


def mix_sources(df: DataFrame, **options) -> DataFrame:
    """df has doc_id, source and size (and `tie`, a number that tells rows of one id apart, if it is to
    order them). Adds source_size, target and taken (words, repeats counted), to which columns of these
    names give way."""
    results = ("source_size", "target", "taken")
    return _served(df, **options).select(*[field("doc", c) for c in df.columns if c.lower() not in results], *results)


def mixed_documents(docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The mix as documents: a row for each whole pass over a text, and one for a part taken of it.
    Texts stay where they are unless more rows are taken than may be broadcast; then they are joined once."""
    own = docs.select(docs[f"`{doc_id}`"].alias("doc_id"), docs[f"`{source}`"].alias("source"), n_words(docs[f"`{text}`"]).alias("size"), F.xxhash64(docs[f"`{text}`"]).alias("tie"), own_columns(docs, "whole"))
    mixed = _served(own, **options).where(F.col("taken") > 0).select("doc.whole", "size", "taken")
    whole, part = F.floor(F.col("taken") / F.col("size")), F.col("taken") % F.col("size")
    rows = mixed.withColumns({"full": whole, "part": part, "pass": F.explode(F.sequence(F.lit(1).cast("long"), whole + F.when(part > 0, 1).otherwise(0)))})
    old = F.col(field("whole", text))
    new = F.when(F.col("pass") <= F.col("full"), old).otherwise(first_words(old, F.col("part"))).alias(text)
    return rows.select(*[new if c == text else F.col(field("whole", c)) for c in docs.columns])


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of every row of documents: all words of all sources as budget, weights 5, 2, 1 in turn."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"))
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


OP10_TARGETS_SQL = r"""
WITH s AS (SELECT source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM s GROUP BY source),
w AS (SELECT *, CASE rk % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 3 * source_size AS cap FROM t),
l AS (SELECT *, (sum(source_size) OVER () - (sum(cap) OVER (ORDER BY cap / weight, rk ROWS UNBOUNDED PRECEDING) - cap))
        / sum(weight) OVER (ORDER BY cap / weight, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w)
SELECT source, source_size, least(CAST(cap AS DOUBLE), weight * max(level) OVER ()) AS target FROM l
"""
