r"""The prefix trie of conversations, with subtree totals by parallel tree contraction.

A node is a distinct sequence of first turns. Its key is a sum over its turns of 180 bits of the SHA-256
of place, role and text, so keys of all prefixes are running sums: they are taken within stretches of
STRETCH turns and over stretches, and no conversation, however long, is one window. Nodes are numbered by
their smallest member and depth. Members are counted by key, combined before the shuffle; a node's parent
is found by key, where Spark's skew join splits nodes with very many children; subtree totals come from
contraction.subtree_totals. Digests of the members that end at a node are taken by a pass over sorted
stretches of ids: ids of one range of MEMBERS are put together first, so that what one task must read in
order is a few rows, and a row is bounded.

Positions of turns come from one sort by ranges of the whole table: rows are numbered in its order, and a
conversation that spans ranges gets the counts of those before.

Defined cases: a null role or text counts as empty; turns are ordered by number (null first), equal
numbers by role, then by the text's digest; repeated rows are turns of their own; rows of no conv_id are
no conversation; a turnless conversation is a member of the root; texts of any length are only digested
and counted; other columns are not read; an empty table gives an empty result, without a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echolark.core import scratch, staged
from echolark.llm.contraction import subtree_totals
from echolark.llm.mixing import n_words

STRETCH, MEMBERS = 1024, 512
DONORS, MOST_TAKEN = 20, 4
EMPTY = hashlib.sha256(b"").hexdigest()
PARTS = 3


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, digest, words), staged: each conversation's turns from 1, by a sort of the whole table."""
    role, text = (F.coalesce(conversations[c], F.lit("")) for c in ("role", "text"))
    content = F.sha2(F.concat_ws(":", F.octet_length(role), role, text), 256)
    rows = conversations.where(conversations["conv_id"].isNotNull()).select(conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].alias("turn"), role.alias("role"), F.sha2(text, 256).alias("tie"), content.alias("digest"), n_words(text).alias("words"))
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "tie"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = staged(rows.select("conv_id", "digest", "words", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("row")))
    held = rows.groupBy("conv_id", "range").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    held = staged(held.select("conv_id", "range", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first") + 1).alias("shift")))
    return staged(rows.join(held, ["conv_id", "range"]).select("conv_id", (F.col("row") + F.col("shift")).alias("at"), "digest", "words"))


def taken_from_donor(conv_id: Column) -> Column:
    """How many turns a conversation takes over: crc32 of its decimal id, modulo 4."""
    return F.crc32(conv_id.cast("string").cast("binary")) % MOST_TAKEN


def rebuilt(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, words) of the rebuilt conversations `convs` (conv_id, taken, n): the first `taken` turns of
    conversation conv_id - conv_id % 20, then the own turns after as many."""
    donor = F.col("conv_id") - F.col("conv_id") % DONORS
    head = turns.where(F.col("at") < MOST_TAKEN).select(F.col("conv_id").alias("donor"), "at", "digest", "words")
    heads = staged(convs.where("taken > 0").select("conv_id", "taken", donor.alias("donor")).join(head, "donor").where(F.col("at") <= F.col("taken")).select("conv_id", F.col("at").alias("depth"), "digest", "words"))
    got = heads.groupBy("conv_id").agg(F.max("depth").alias("got"))
    of = staged(convs.join(got, "conv_id", "left").select("conv_id", "taken", F.coalesce("got", F.lit(0)).alias("got")))
    own = turns.join(of, "conv_id").where(F.col("at") > F.col("taken")).select("conv_id", (F.col("at") - F.col("taken") + F.col("got")).alias("depth"), "digest", "words")
    return staged(heads.union(own))


def _sums(prefix: str) -> list[str]:
    return [f"{prefix}{k}" for k in range(PARTS)]


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, key, before, words): for each turn the keys of the prefix that it ends and of the one before it."""
    mixed = F.sha2(F.concat_ws(":", "depth", "digest"), 256)
    numbers = [F.conv(F.substring(mixed, 1 + 15 * k, 15), 16, 10).cast("decimal(19,0)").alias(c) for k, c in enumerate(_sums("v"))]
    rows = staged(turns.select("conv_id", "depth", "words", F.floor(F.col("depth") / STRETCH).alias("stretch"), *numbers))
    earlier = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("decimal(29,0)")
    bases = rows.groupBy("conv_id", "stretch").agg(*[F.sum(v).alias(v) for v in _sums("v")])
    bases = staged(bases.select("conv_id", "stretch", *[F.coalesce(F.sum(v).over(earlier), zero).cast("decimal(38,0)").alias(b) for v, b in zip(_sums("v"), _sums("b"), strict=True)]))
    within = Window.partitionBy("conv_id", "stretch").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    upto = [(F.col(b) + F.sum(v).over(within)).cast("decimal(38,0)") for v, b in zip(_sums("v"), _sums("b"), strict=True)]
    rows = rows.join(bases, ["conv_id", "stretch"]).select("conv_id", "depth", "words", *_sums("v"), *[u.alias(s) for u, s in zip(upto, _sums("s"), strict=True)])
    before = [(F.col(s) - F.col(v)).cast("decimal(38,0)") for s, v in zip(_sums("s"), _sums("v"), strict=True)]
    return rows.select("conv_id", "depth", "words", key_of(F.col("depth"), *_sums("s")).alias("key"), key_of(F.col("depth") - 1, *before).alias("before"))


def key_of(depth: Column, *sums) -> Column:
    return F.unhex(F.sha2(F.concat_ws(":", depth.cast("string"), *[F.col(s).cast("string") if isinstance(s, str) else s.cast("string") for s in sums]), 256))


def ends_digest(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of ends (key, conv_id): SHA-256 of each key's ids in order, in decimal, with commas.
    Ids of one range of MEMBERS come together first; a pass over sorted rows then feeds them to the digest."""
    block = F.floor(F.col("conv_id") / MEMBERS)
    ids = F.array_join(F.transform(F.sort_array(F.collect_set("conv_id")), lambda x: x.cast("string")), ",")
    blocks = ends.groupBy("key", block.alias("block")).agg(ids.alias("ids"))
    blocks = blocks.repartition("key").sortWithinPartitions("key", "block").select("key", "ids")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for b in batches:
            done = []
            for k, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k == key:
                    sha.update(b"," + ids.encode())
                    continue
                if sha:
                    done.append((key, sha.hexdigest()))
                key, sha = k, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())], names=["key", "ends_sha256"])
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([sha.hexdigest()])], names=["key", "ends_sha256"])

    return blocks.mapInArrow(digests, "key binary, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes of the trie of turns (conv_id, depth from 1, digest, words) of conversations `convs` (conv_id, some turnless):
    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. Staged."""
    spark = turns.sparkSession
    with scratch(spark):
        paths = staged(prefixes(turns))
        root_key = key_of(F.lit(0).cast("long"), *[F.lit(0).cast("decimal(38,0)")] * PARTS)
        sizes = [F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")]
        nodes = paths.groupBy("key", "before", "depth").agg(*sizes, F.min("words").alias("words"))
        root = convs.agg(*sizes).where("n_convs > 0").select(root_key.alias("key"), F.lit(None).cast("binary").alias("before"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("words"))
        nodes = staged(nodes.union(root))
        last = convs.join(paths.groupBy("conv_id").agg(F.max("depth").alias("depth")), "conv_id", "left")
        last = staged(last.select("conv_id", F.coalesce("depth", F.lit(0).cast("long")).alias("depth")))
        ending = paths.select("conv_id", "depth", "key").join(last, ["conv_id", "depth"]).select("key", "conv_id")
        ends = staged(ends_digest(ending.union(last.where("depth = 0").select(root_key.alias("key"), "conv_id"))))
        parents = nodes.select(F.col("key").alias("before"), F.col("conv_id").alias("parent"))
        placed = nodes.join(parents, "before", "left").select("key", F.col("conv_id").alias("node"), "depth", "parent", F.when(F.col("parent").isNotNull(), F.col("depth") - 1).alias("parent_depth"), "n_convs", "words")
        kids = nodes.where("before is not null").groupBy(F.col("before").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
        placed = staged(placed.join(kids, "key", "left").join(ends, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))).drop("key"))
        own = placed.select("node", "depth", "parent", "parent_depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
        deepest = placed.agg(F.max("depth")).first()[0] or 0
        totals = subtree_totals(own, ["n_leaves", "saved_tokens"], max(1, deepest.bit_length()))
        found = placed.join(totals, ["node", "depth"])
        return staged(found.select(F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")), keep=True)


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    with scratch(conversations.sparkSession):
        turns = turns_in_order(conversations)
        convs = staged(turns.select("conv_id").distinct().withColumn("taken", taken_from_donor(F.col("conv_id"))))
        return staged(trie(rebuilt(turns, convs), convs.select("conv_id")), keep=True)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all rebuilt conversations."""
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


OP13_SQL = r"""
WITH RECURSIVE c AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
bits AS (SELECT range AS i, range::UBIGINT AS x, 0 AS step FROM range(256)
    UNION ALL SELECT i, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, step + 1 FROM bits WHERE step < 8),
crc_table AS (SELECT list(x ORDER BY i) AS t FROM bits WHERE step = 8),
ids AS (SELECT DISTINCT conv_id FROM c),
crc AS (SELECT conv_id, conv_id::VARCHAR AS s, 1 AS k, 4294967295::UBIGINT AS x FROM ids
    UNION ALL SELECT conv_id, s, k + 1, xor(x >> 8, t[CAST(xor(x & 255, ascii(s[k])) AS INT) + 1]) FROM crc, crc_table WHERE k <= length(s)),
h AS (SELECT conv_id, CAST(xor(x, 4294967295) % 4 AS BIGINT) AS h FROM crc WHERE k = length(s) + 1),
d AS (SELECT h.conv_id, c.pos, c.role, c.text FROM h JOIN c ON c.conv_id = h.conv_id - h.conv_id % 20 AND c.pos <= h.h
    UNION ALL SELECT c.conv_id, c.pos + 1000000000, c.role, c.text FROM c JOIN h USING (conv_id) WHERE c.pos > h.h),
r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth FROM d),
p AS MATERIALIZED (SELECT conv_id, depth, text, sha256(string_agg(sha256(length(role) || ':' || role || text), ',') OVER (PARTITION BY conv_id ORDER BY depth)) AS key FROM r
    UNION ALL SELECT conv_id, 0, '', '' FROM ids),
n AS (SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, len(regexp_extract_all(any_value(text), '[^\x20\x09-\x0D]+')) AS words FROM p GROUP BY depth, key),
l AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id),
e AS (SELECT p.depth, p.key, sha256(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id)) AS ends_sha256 FROM p JOIN l USING (conv_id, depth) GROUP BY p.depth, p.key),
m AS (SELECT p.conv_id AS member, n.* FROM n JOIN p USING (depth, key)),
k AS MATERIALIZED (SELECT n.*, u.conv_id AS parent_conv_id FROM n LEFT JOIN m u ON u.member = n.conv_id AND u.depth = n.depth - 1),
f AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM k WHERE depth > 0 GROUP BY ALL),
v AS (SELECT k.*, coalesce(n_children, 0) AS n_children FROM k LEFT JOIN f USING (conv_id, depth)),
s AS (SELECT a.conv_id, a.depth, sum(CASE WHEN v.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((v.n_convs - 1) * v.words) AS saved_tokens
    FROM v JOIN m a ON a.member = v.conv_id AND a.depth <= v.depth GROUP BY a.conv_id, a.depth)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, v.parent_conv_id, v.n_convs, CAST(v.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
    CAST(saved_tokens AS BIGINT) AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM v JOIN s USING (conv_id, depth) LEFT JOIN e ON e.depth = v.depth AND e.key = v.key
"""
