r"""Near-duplicate classes by a signature-coordinate inverted join.

A document's MinHash signature has COORDINATES values. Documents are posted under each pair of
coordinate and value; two linked documents share at least matches(percent) pairs (the chance that a
pair at the threshold shares fewer is below 1e-6: 3.7e-7 for 27 at 0.85, 7.8e-7 for 24 at 0.80). Two steps keep lists short without losing a candidate:
- Prefix: with each document's pairs ordered by list length, rarest first, documents that share
  M of them share one of their first COORDINATES - M + 1. Only these lists are merged;
  pairs that no other document has are counted into the prefix and dropped.
- Skip: the longer lists beyond the prefix are never merged; for candidates their collisions are
  counted by intersecting the two signatures.
Equal shingle sets are one class before anything is posted; they are told apart by their size and two
keyed 64-bit sums over all their shingles. In each list documents first meet only its most central
member (of the longest lists overall); pairs of enough collisions that are confirmed on full sets make
components. Lists that then hold more than one component have pairs across components found by a
second inverted join, on what each document has or lacks against that member (see residual_pairs),
which keeps every link and does not meet copies that each differ in a way of their own. Pairs inside
a component need no test. Every link is confirmed on the full shingle sets.

Defined cases: null, empty or all-space texts have an empty set and are linked with nothing; texts
of fewer words than a shingle are one shingle; texts of any length have all their shingles read;
null ids count as greater than all others; rows that repeat a doc_id are told apart by their place
where one document of a class stays, while component_id and kept of the query speak of ids; other
columns, whatever their names, pass through `drop_near_copies`; an empty table gives an empty result.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolark.core import broadcast_if_small, field, own_columns, scratch, small_batches, staged
from echolark.llm.components import components
from echolark.llm.textbytes import LOWER, Texts, mix, run_hashes, texts_of, windows, words_of

COORDINATES, MISSED = 48, 1e-6
PAIRS_AT_ONCE = 64
_seeds = mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_FACTORS, _SHIFTS = _seeds[:COORDINATES] | np.uint64(1), _seeds[COORDINATES:]


def matches(percent: int) -> int:
    """The most coordinates of which a pair at the threshold shares fewer with a chance below MISSED."""
    p, tail = percent / 100, 0.0
    for m in range(COORDINATES):
        tail += comb(COORDINATES, m) * p**m * (1 - p) ** (COORDINATES - m)
        if tail >= MISSED:
            return max(1, m)
    return COORDINATES


def shingle_sets(t: Texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles of each document, ordered by both."""
    low = Texts(LOWER[t.data], t.offsets)
    words = words_of(low)
    hashes = run_hashes(low.data, words.starts, words.ends)
    at, keys = windows(hashes, words.doc, width)
    doc = words.doc[at]
    count = np.diff(words.first)
    for n in range(1, width):
        short = np.flatnonzero(count == n)
        whole = np.zeros(len(short), np.uint64)
        for k in range(n):
            whole = mix(whole + hashes[words.first[short] + k] + np.uint64(k + 101 * n))
        doc, keys = np.concatenate([doc, short]), np.concatenate([keys, whole])
    order = np.lexsort((keys, doc))
    doc, keys = doc[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1])
    return doc[new], keys[new]


def signatures(column: pa.Array, width: int) -> pa.Array:
    sizes, keys1, keys2, rows = [], [], [], []
    for t in texts_of(column):
        doc, keys = shingle_sets(t, width)
        n = np.bincount(doc, minlength=len(t))
        full = np.flatnonzero(n)
        first = (np.cumsum(n) - n)[full]
        sums = np.zeros((2, len(t)), np.uint64)
        signature = np.zeros((len(t), COORDINATES), np.int64)
        if len(full):
            sums[0, full], sums[1, full] = np.add.reduceat(mix(keys), first), np.add.reduceat(mix(keys ^ np.uint64(0x5851F42D4C957F2D)), first)
            for c in range(COORDINATES):
                values = (keys * _FACTORS[c] + _SHIFTS[c]) >> np.uint64(32)
                signature[full, c] = np.minimum.reduceat(values, first).astype(np.int64) | (c << 32)
        sizes.append(n)
        keys1.append(sums[0].view(np.int64))
        keys2.append(sums[1].view(np.int64))
        rows.append(signature)
    glued = (lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind))
    flat = glued(rows, np.int64).reshape(-1)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, COORDINATES, dtype=np.int32)), pa.array(flat))
    return pa.StructArray.from_arrays([pa.array(glued(sizes, np.int64).astype(np.int64)), pa.array(glued(keys1, np.int64)), pa.array(glued(keys2, np.int64)), lists], names=["n", "k1", "k2", "sig"])


def _merged(left: pa.Array, right: pa.Array, width: int) -> tuple[np.ndarray, ...]:
    """(pair, key, side, both) of the shingle sets of each pair of texts, ordered by pair and key."""
    parts = []
    for side, column in enumerate((left, right)):
        base = 0
        for t in texts_of(column):
            doc, key = shingle_sets(t, width)
            parts.append((doc + base, key, np.full(len(key), side, np.int8)))
            base += len(t)
    pair, key, side = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((side, key, pair))
    pair, key, side = pair[order], key[order], side[order]
    same = (pair[1:] == pair[:-1]) & (key[1:] == key[:-1])
    both = np.zeros(len(key), bool)
    both[1:] |= same
    both[:-1] |= same
    return pair, key, side, both


def overlap_of(left: pa.Array, right: pa.Array, width: int) -> np.ndarray:
    """(intersection, union) sizes of the shingle sets of each pair of texts."""
    out = [np.zeros((0, 2), np.int64)]
    for start in range(0, len(left), PAIRS_AT_ONCE):
        a, b = left.slice(start, PAIRS_AT_ONCE), right.slice(start, PAIRS_AT_ONCE)
        pair, _, side, both = _merged(a, b, width)
        shared = np.bincount(pair[both & (side == 0)], minlength=len(a))
        out.append(np.stack([shared, np.bincount(pair, minlength=len(a)) - shared], axis=1))
    return np.concatenate(out)


def difference_of(left: pa.Array, right: pa.Array, width: int) -> pa.Array:
    """The shingles that only one text of each pair has."""
    keys, sizes = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for start in range(0, len(left), PAIRS_AT_ONCE):
        a, b = left.slice(start, PAIRS_AT_ONCE), right.slice(start, PAIRS_AT_ONCE)
        pair, key, _, both = _merged(a, b, width)
        keys.append(key[~both])
        sizes.append(np.bincount(pair[~both], minlength=len(a)))
    return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)).astype(np.int32)), pa.array(np.concatenate(keys).view(np.int64)))


def with_signatures(df: DataFrame, width: int, text: str = "text") -> DataFrame:
    """df's columns as the struct doc, staged with a row number and the signature columns."""
    small_batches(df.sparkSession)
    sign = F.arrow_udf(lambda x: signatures(x, width), "struct<n:bigint,k1:bigint,k2:bigint,sig:array<bigint>>")
    own = df.select(own_columns(df), F.monotonically_increasing_id().alias("row"), sign(F.col(f"`{text}`")).alias("s"))
    return staged(own.select("doc", "row", "s.*"))


def prefix_postings(nodes: DataFrame, percent: int) -> DataFrame:
    """(key, node, score): each node under the pairs of its prefix that others have too."""
    posted = nodes.select("node", F.explode("sig").alias("key"))
    lengths = staged(posted.groupBy("key").agg(F.count(F.lit(1)).alias("f")).where("f > 1"))
    shared = posted.join(lengths, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("f", "key"))).alias("held"))
    # singles come first in the order, so the prefix reaches that much less far into the shared ones
    reach = F.size("held") - (matches(percent) - 1)
    score = F.aggregate("held", F.lit(0).cast("long"), lambda s, h: s + h.f)
    cut = shared.where(reach > 0).select("node", score.alias("score"), F.explode(F.slice("held", F.lit(1), reach)).alias("h"))
    return staged(cut.select(F.col("h.key").alias("key"), "node", "score"))


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (a, b) with both texts; a, which may be a hub, is joined last, so that its text moves once."""
    side = lambda k: texts.select(F.col("node").alias(k), F.col("text").alias(f"text_{k}"))
    return pairs.join(side("b"), "b").join(side("a"), "a")


def linked(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union, on full sets."""

    def test(left: pa.Array, right: pa.Array) -> pa.Array:
        found = overlap_of(left, right, width)
        return pa.array(100 * found[:, 0] >= percent * found[:, 1])

    return staged(_with_texts(pairs.select("a", "b"), texts).where(F.arrow_udf(test, "boolean")("text_a", "text_b")).select("a", "b"))


def with_collisions(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """pairs (a, b) with the number of coordinates in which their signatures agree."""
    side = lambda k: nodes.select(F.col("node").alias(k), F.col("sig").alias(f"sig_{k}"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a")
    return joined.withColumn("hits", F.size(F.array_intersect("sig_a", "sig_b"))).drop("sig_a", "sig_b")


def _met_by_prefix(members: DataFrame, percent: int) -> DataFrame:
    """(a, b) of members (list, form, node, label, tags, second, need, need_second, load): pairs with
    different labels, one of them `second`, that may share (load_a + load_b) / 2 (100 + percent) tags, and
    each `need` of its own at least.

    Tags that do not occur under two labels, or under no `second`, cannot be shared by such a pair and
    go; of the rest, rarest first, the pair shares one within the first (count - need + 1) of both. At
    the first one shared, what both still have ahead bounds what they share."""
    at = ["list", "form"]
    tagged = members.select(*at, "node", "label", "second", F.explode("tags").alias("tag"))
    spread = tagged.groupBy(*at, "tag").agg(F.count(F.lit(1)).alias("f"), F.min("label").alias("l0"), F.max("label").alias("l1"), F.max("second").alias("any"))
    spread = staged(spread.where("l0 != l1 and any").select(*at, "tag", "f"))
    held = tagged.join(spread, [*at, "tag"]).groupBy(*at, "node").agg(F.sort_array(F.collect_list(F.struct("f", "tag"))).alias("held"))
    held = staged(held.join(members.drop("tags"), [*at, "node"]))
    reach = lambda need: F.size("held") - F.col(need) + 1

    def posted(side: str, need: str) -> DataFrame:
        own = held.where((reach(need) > 0) & (F.lit(side == "a") | F.col("second")))
        own = own.select(*at, F.col("node").alias(side), F.col("label").alias(f"label_{side}"), F.col("load").alias(f"load_{side}"), F.col("second").alias(f"second_{side}"), F.size("held").alias("count"), F.posexplode(F.slice("held", F.lit(1), reach(need))).alias("place", "h"))
        return staged(own.withColumns({"tag": F.col("h.tag"), f"ahead_{side}": F.col("count") - F.col("place")}).drop("h", "count", "place"))

    a, b = posted("a", "need"), posted("b", "need_second")
    once = ~F.col("second_a") | (F.col("a") < F.col("b"))
    enough = F.lit(2 * (100 + percent)) * F.least("ahead_a", "ahead_b") >= F.col("load_a") + F.col("load_b")
    return a.join(b, [*at, "tag"]).where((F.col("label_a") != F.col("label_b")) & once & enough).select("a", "b").distinct()


def residual_pairs(stars: DataFrame, labels: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Candidates (a, b) between different components among the documents that met one leader.

    Let D(x) be the shingles that only one of x and its leader L has. Then |a - b| + |b - a| =
    |D(a)| + |D(b)| - 2 |D(a) & D(b)|, and a link allows t (n_a + n_b) of it, t = (100 - p) / (100 + p).
    If b is not linked with L, D(b) has over t (n_b + n_L), so a link of a and b needs
      |D(a) & D(b)| > (|D(a)| - t (n_a - n_L)) / 2   and   |D(a) & D(b)| >= (|D(b)| - t (n_b + n_L)) / (1 + t).
    What copies changed each for itself, only one of them has, so that few are left to meet; and two that
    meet must share (|D(a)| + |D(b)| - t (n_a + n_b)) / 2, which their loads add up to. Documents
    of few collisions with L (unlike it) meet the others under coordinates instead, of which linked
    ones share matches(percent)."""
    of = labels.select("node", "label")
    own = stars.select(F.col("a").alias("list")).distinct()
    met = stars.select(F.col("a").alias("list"), F.col("b").alias("node"), "hits").union(own.select("list", F.col("list").alias("node"), F.lit(COORDINATES)))
    main = own.join(of.withColumnRenamed("node", "list"), "list", "left").select("list", F.coalesce("label", "list").alias("main"))
    placed = staged(met.join(of, "node", "left").withColumn("label", F.coalesce("label", "node")).join(main, "list").withColumn("outside", F.col("label") != F.col("main")))
    mixed = staged(placed.where("outside").groupBy("list").agg(F.count(F.lit(1)).alias("strangers")))
    size = nodes.select(F.col("node").alias("list"), F.col("n").alias("n_list"))
    members = staged(placed.join(mixed, "list").join(size, "list").join(nodes.select("node", "n", "sig"), "node"))
    near = F.col("hits") >= COORDINATES // 3
    differ = F.arrow_udf(lambda a, b: difference_of(a, b, width), "array<bigint>")
    pairs = members.where(near & (F.col("node") != F.col("list"))).select(F.col("list").alias("a"), F.col("node").alias("b"))
    beyond = _with_texts(pairs, texts).select(F.col("a").alias("list"), F.col("b").alias("node"), differ("text_a", "text_b").alias("tags"))
    d, p = F.size("tags"), percent
    close = staged(members.where(near).join(beyond, ["list", "node"]).withColumn("over", (100 + p) * d - (100 - p) * (F.col("n") + F.col("n_list"))))
    common = ["node", "label", "tags", "second", "need", "need_second", "load"]
    by_difference = close.select(
        "list", F.lit("difference").alias("form"), "node", "label", "tags", (F.col("outside") & (F.col("over") > 0)).alias("second"),
        (F.floor(((100 + p) * d - (100 - p) * (F.col("n") - F.col("n_list"))) / (2.0 * (100 + p))) + 1).cast("int").alias("need"),
        F.greatest(F.lit(1), F.ceil(F.col("over") / 200.0)).cast("int").alias("need_second"),
        ((100 + p) * d - (100 - p) * F.col("n")).cast("long").alias("load"),
    )
    unlike = staged(members.where(~near).select("list").distinct())
    need = F.lit(matches(percent))
    by_coordinate = members.join(unlike, "list").select("list", F.lit("coordinate").alias("form"), "node", "label", F.col("sig").alias("tags"), (~near).alias("second"), need.alias("need"), need.alias("need_second"), (need * (100 + p)).cast("long").alias("load"))
    found = _met_by_prefix(staged(by_difference.select("list", "form", *common).union(by_coordinate.select("list", "form", *common))), percent)
    direct = close.where("outside and over <= 0").select(F.col("list").alias("a"), F.col("node").alias("b"))
    return with_collisions(found.union(direct).distinct(), nodes).where(F.col("hits") >= matches(percent)).select("a", "b")


def near_classes(rows: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, percent: int = 85) -> DataFrame:
    """row, doc_id, n_shingles, label (of the component, unique), component_id and kept of rows from with_signatures()."""
    with scratch(rows.sparkSession):
        named = _components_of_sets(rows, field("doc", doc_id), field("doc", text), width, percent)
    own = rows.select("row", F.col(field("doc", doc_id)).alias("doc_id"), "n", "k1", "k2")
    component = F.when(F.col("n") > 0, F.col("smallest")).otherwise(F.col("doc_id")).alias("component_id")
    out = own.join(named, ["k1", "k2", "n"], "left").select("row", "doc_id", F.col("n").alias("n_shingles"), "label", component)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _components_of_sets(rows: DataFrame, doc_id: str, text: str, width: int, percent: int) -> DataFrame:
    """(k1, k2, n, label, smallest): the component of each different shingle set, and its smallest id."""
    full = rows.where("n > 0")
    nodes = full.groupBy("k1", "k2", "n").agg(F.min("row").alias("node"), F.min(F.col(doc_id)).alias("least"), F.first("sig").alias("sig"))
    nodes = staged(nodes)
    postings = prefix_postings(nodes, percent)
    leaders = postings.groupBy("key").agg(F.max(F.struct("score", (-F.col("node")).alias("minus"))).alias("top"), F.count(F.lit(1)).alias("size"))
    leaders = staged(leaders.where("size > 1").select("key", (-F.col("top.minus")).alias("leader")))
    stars = postings.join(leaders, "key").where("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    stars = staged(with_collisions(stars, nodes).select("a", "b", "hits"))
    texts = rows.select(F.col("row").alias("node"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    links = linked(stars.where(F.col("hits") >= matches(percent)), texts, width, percent)
    labels = staged(components(links))
    more = staged(residual_pairs(stars, labels, nodes, texts, width, percent))
    if not more.isEmpty():
        labels = staged(components(links.union(linked(more, texts, width, percent))))
    found = staged(nodes.join(labels, "node", "left").select("k1", "k2", "n", "least", F.coalesce("label", "node").alias("label")))
    smallest = staged(found.groupBy("label").agg(F.min("least").alias("smallest")))
    return staged(found.join(smallest, "label").select("k1", "k2", "n", "label", "smallest"), keep=True)


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, percent: int = 85) -> DataFrame:
    """docs with one document of each near-duplicate class: the one of the smallest id, of rows that
    share this id the first of the table."""
    rows = with_signatures(docs, width, text)
    classes = near_classes(rows, doc_id, text, width, percent)
    with scratch(docs.sparkSession):
        found = staged(classes.where("n_shingles > 0").select("row", "doc_id", "label"))
        stays = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
        dropped = found.select("row").join(stays.select(F.col("first.row").alias("row")), "row", "left_anti")
        dropped = staged(dropped, keep=True)
    return rows.select("doc", "row").join(broadcast_if_small(dropped), "row", "left_anti").select("doc.*")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every row of documents: shingles of 3 words, similarity 0.85."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_classes(with_signatures(docs, 3)).select("doc_id", "n_shingles", "component_id", "kept")
