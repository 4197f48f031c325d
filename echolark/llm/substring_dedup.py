"""Removal of repeated byte strings across a corpus by suffix arrays over sampled places.

A string of SPAN bytes is repeated if it also starts earlier: in a document of smaller id, or before
in its own. Every window of SPAN bytes contains an anchor, the least hashed GRAM bytes in it, so equal
windows have their anchor at the same offset, and a corpus-wide suffix array splits into independent
ones by anchor. The windows of one anchor place form a run; three steps decide each run:
1. Runs whose whole bytes equal an earlier run's, by two 64-bit hashes (of the anchor and of all bytes;
   the bytes themselves are not compared), are repeated throughout (first within a batch, then
   after one shuffle of (anchor, hash, id, place); anchors frequent in a bounded sample of documents
   are salted by run hash, which moves rows but changes no result).
2. The first run of each kind stays open where its anchor has runs of another kind. The bytes of open
   runs meet by anchor, in pieces of PIECE_RUNS at most; each batch is put into one suffix array, and
   neighbours that share SPAN bytes are equal windows, of which the earliest is kept.
3. An anchor dealt over several pieces has the pieces' earliest windows compared by 128-bit hash.

Defined cases: null counts as empty and keeps the empty string's hash; matches never cross documents;
rows that repeat an id are ordered by their text's hash and place in the table, as are null ids, which
come first, as ids that are no whole numbers are by their own order; other columns do not enter; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from echolark.core import small_batches, staged
from echolark.llm import textbytes
from echolark.llm.suffix_array import common_prefixes, suffix_array, words8
from echolark.llm.textbytes import BYTE_CODES, Texts, mix, powers, texts_of

SPAN, GRAM = 100, 32
PLACES = SPAN - GRAM + 1
SAMPLE_DOCS, SAMPLE_SHARE, MAX_FREQUENT, SALTS = 2_000, 200, 1_000, 64
PIECE_RUNS = 4_096
ARRAY_BYTES = 512 << 10
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
_INVERSE = pow(int(textbytes._MULTIPLIER), -1, 1 << 64)
_inverses = np.ones(1, np.uint64)


def _inverse_powers(n: int) -> np.ndarray:
    global _inverses
    if len(_inverses) < n:
        grown = np.full(max(n, 2 * len(_inverses)), _INVERSE, np.uint64)
        grown[0] = 1
        _inverses = np.cumprod(grown, dtype=np.uint64)
    return _inverses[:n]


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours."""
    n = len(v)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = v
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


class Runs:
    """Runs of windows of a Texts: anchor key, hash of all bytes, document, first and last window."""

    def __init__(self, t: Texts):
        d, n = t.data, len(t.data)
        if n < SPAN:
            self.key = self.whole = np.zeros(0, np.uint64)
            self.doc = self.first = self.last = np.zeros(0, np.int64)
            return
        w = words8(d)
        h = w[: n - GRAM + 1] * _ODD[0]
        for k in range(1, GRAM // 8):
            h += w[8 * k : 8 * k + len(h)] * _ODD[k]
        h = mix(h)
        place = _least((h & ~np.uint64(0xFFFFFFFF)) | np.arange(len(h), dtype=np.uint64), PLACES) & np.uint64(0xFFFFFFFF)
        starts = np.concatenate([np.arange(a, b - SPAN + 1) for a, b in zip(t.offsets[:-1].tolist(), t.offsets[1:].tolist(), strict=True) if b - a >= SPAN] or [np.zeros(0, np.int64)])
        place = place[starts].astype(np.int64)
        # windows of two documents never have an anchor in common, as starts skip SPAN - 1 places
        new = np.ones(len(starts), bool)
        new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
        at = np.flatnonzero(new)
        self.first = starts[at]
        self.last = starts[np.append(at[1:], len(starts)) - 1] if len(at) else self.first
        self.key = h[place[at]]
        self.doc = np.searchsorted(t.offsets, self.first, "right") - 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_CODES[d] * powers(n), out=sums[1:])
        size = (self.last - self.first).astype(np.uint64)
        self.whole = mix((sums[self.last + SPAN] - sums[self.first]) * _inverse_powers(n)[self.first] + size * _ODD[1])


RUN_SCHEMA = "key bigint, whole bigint, doc bigint, start int, stop int"


def runs_of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text) to runs; one that equals an earlier run of its batch has no key: it is settled."""
    for batch in batches:
        ids, base = batch.column(0).to_numpy(zero_copy_only=False), 0
        for t in texts_of(batch.column(1)):
            r = Runs(t)
            doc = ids[base + r.doc]
            start = r.first - t.offsets[r.doc]
            pair = mix(r.key ^ mix(r.whole))
            order = np.lexsort((start, doc, pair))
            again = np.zeros(len(order), bool)
            again[order[1:]] = pair[order[1:]] == pair[order[:-1]]
            base += len(t)
            yield pa.RecordBatch.from_arrays([pa.array(r.key.view(np.int64), mask=again), pa.array(r.whole.view(np.int64)), pa.array(doc), pa.array(start.astype(np.int32)), pa.array((r.last - t.offsets[r.doc]).astype(np.int32))], names=["key", "whole", "doc", "start", "stop"])


def _numbered(docs: DataFrame) -> DataFrame:
    """(doc, doc_id, text) with doc unique and ordered like doc_id; ids serve themselves if they can."""
    n, different = docs.agg(F.count(F.lit(1)), F.countDistinct("doc_id")).first()
    text = F.coalesce("text", F.lit("")).alias("text")
    if n == different and docs.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long"):
        return docs.select(F.col("doc_id").cast("long").alias("doc"), "doc_id", text)
    ordered = docs.select("doc_id", text).orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return staged(ordered.select(F.monotonically_increasing_id().alias("doc"), "doc_id", "text"))


def _frequent(docs: DataFrame) -> list[int]:
    """Anchor keys that at least one in SAMPLE_SHARE documents of a bounded sample has, MAX_FREQUENT at most."""
    chosen = docs.select("doc").orderBy(F.xxhash64(F.lit(3), "doc")).limit(SAMPLE_DOCS)
    some = docs.select("doc", "text").join(F.broadcast(chosen), "doc").mapInArrow(runs_of_batches, RUN_SCHEMA).where("key is not null")
    counts = some.groupBy("key").agg(F.countDistinct("doc").alias("n")).where(F.col("n") >= SAMPLE_DOCS // SAMPLE_SHARE)
    return [r.key for r in counts.orderBy(F.desc("n"), "key").limit(MAX_FREQUENT).collect()]


def _cut_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, runs, text) to the bytes of each open run."""
    for batch in batches:
        texts = [x.as_py().encode() for x in batch.column("text")]
        docs, lists = batch.column("doc").to_pylist(), batch.column("runs").to_pylist()
        rows = [(r["key"], r["piece"], r["pieces"], d, r["start"], r["stop"], text[r["start"] : r["stop"] + SPAN]) for d, runs, text in zip(docs, lists, texts, strict=True) for r in runs]
        for k in range(0, len(rows), 20_000):
            columns = list(zip(*rows[k : k + 20_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["key", "piece", "pieces", "doc", "start", "stop", "bytes"])


WINDOW_SCHEMA = "doc bigint, start int, stop int, h1 bigint, h2 bigint"


def _equal_windows(doc: np.ndarray, start: np.ndarray, pieces: np.ndarray, raw: list[bytes]) -> pa.RecordBatch:
    """One suffix array over the runs' bytes: windows that have an equal, earlier one, joined to spans,
    and, for anchors in several pieces, each earliest window with its hash."""
    lengths = np.array([len(x) for x in raw])
    data = np.frombuffer(b"\xff".join(raw) + b"\xff", np.uint8)
    begin = np.cumsum(lengths + 1) - lengths - 1
    words = words8(data)
    order = suffix_array(data, SPAN, words)
    run = np.searchsorted(begin, order, "right") - 1
    window = order + SPAN <= begin[run] + lengths[run]
    # windows keep their order in the array; others between two equal windows do not exist
    order, run = order[window], run[window]
    joined = common_prefixes(order, words, SPAN) >= SPAN
    group = np.cumsum(~joined) - 1
    at = start[run] + order - begin[run]
    rank = np.lexsort((at, doc[run], group))
    repeated = np.zeros(len(order), bool)
    repeated[rank[1:]] = group[rank[1:]] == group[rank[:-1]]
    r_doc, r_at = doc[run][repeated], at[repeated]
    spot = np.lexsort((r_at, r_doc))
    r_doc, r_at = r_doc[spot], r_at[spot]
    new = np.ones(len(r_at), bool)
    new[1:] = (r_doc[1:] != r_doc[:-1]) | (r_at[1:] > r_at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(r_at)) - 1 if len(first) else first
    spans = [r_doc[first], r_at[first], r_at[last]]
    apart = ~repeated & (pieces[run] > 1)
    found = order[apart]
    h = [np.zeros(len(found), np.uint64) for _ in range(2)]
    for k in range(0, SPAN, 8):
        part = words[found + min(k, SPAN - 8)]
        h = [mix(x * _ODD[i] + part + np.uint64(i + 1)) for i, x in enumerate(h)]
    none = np.ones(len(first), bool)
    some = np.zeros(len(found), bool)
    mask = np.concatenate([none, some])
    columns = [np.concatenate([a, b]) for a, b in zip(spans, (doc[run][apart], at[apart], at[apart]), strict=True)]
    hashes = [pa.array(np.concatenate([np.zeros(len(first), np.int64), x.view(np.int64)]), mask=mask) for x in h]
    return pa.RecordBatch.from_arrays([pa.array(columns[0].astype(np.int64)), pa.array(columns[1].astype(np.int32)), pa.array(columns[2].astype(np.int32)), *hashes], names=["doc", "start", "stop", "h1", "h2"])


def _arrays_of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by (key, piece): batches of whole groups, ARRAY_BYTES or one group at a time."""
    held: list[tuple] = []
    size, last = 0, None
    flush = lambda: _equal_windows(*(np.array(x) for x in list(zip(*held, strict=True))[:3]), [x[3] for x in held])
    for batch in batches:
        c = {k: batch.column(k).to_pylist() for k in ("key", "piece", "doc", "start", "pieces", "bytes")}
        for key, piece, doc, start, pieces, raw in zip(*(c[k] for k in ("key", "piece", "doc", "start", "pieces", "bytes")), strict=True):
            if size >= ARRAY_BYTES and (key, piece) != last:
                yield flush()
                held, size = [], 0
            held.append((doc, start, pieces, raw))
            size += len(raw) + 1
            last = (key, piece)
    if held:
        yield flush()


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc, start, stop) of docs (doc, text): runs of window starts whose windows occur earlier."""
    frequent = _frequent(docs)
    runs = docs.select("doc", "text").mapInArrow(runs_of_batches, RUN_SCHEMA)
    often = F.col("key").isin(frequent) if frequent else F.lit(False)
    dealt = F.when(F.col("key").isNull(), F.xxhash64("doc", "start")).when(often, F.xxhash64("key", F.pmod("whole", F.lit(SALTS)))).otherwise(F.col("key"))
    kind = Window.partitionBy("dealt", "key", "whole").orderBy("doc", "start")
    anchor = Window.partitionBy("dealt", "key")
    ranked = runs.withColumn("often", often).withColumn("dealt", dealt).withColumn("rank", F.row_number().over(kind))
    ranked = ranked.withColumn("open", (F.col("rank") == 1) & F.col("key").isNotNull() & (F.coalesce("often", F.lit(False)) | (F.min("whole").over(anchor) != F.max("whole").over(anchor))))
    ranked = staged(ranked.where((F.col("rank") > 1) | F.col("key").isNull() | F.col("open")).select("open", "key", "doc", "start", "stop"))
    settled = ranked.where("not open").select("doc", "start", "stop")
    opened = ranked.where("open")
    sizes = staged(opened.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / PIECE_RUNS).cast("int").alias("pieces")).where("pieces > 1"))
    opened = opened.join(sizes, "key", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    opened = opened.withColumn("piece", F.pmod(F.hash("doc", "start"), "pieces"))
    by_doc = opened.groupBy("doc").agg(F.collect_list(F.struct("key", "piece", "pieces", "start", "stop")).alias("runs"))
    cut = by_doc.join(docs.select("doc", "text"), "doc").mapInArrow(_cut_runs, "key bigint, piece int, pieces int, doc bigint, start int, stop int, bytes binary")
    met = cut.repartition("key", "piece").sortWithinPartitions("key", "piece").mapInArrow(_arrays_of_batches, WINDOW_SCHEMA)
    met = staged(met)
    apart = met.where("h1 is not null")
    leads = staged(apart.groupBy("h1", "h2").agg(F.min(F.struct("doc", "start")).alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    late = apart.join(leads, ["h1", "h2"]).where((F.col("doc") != F.col("lead.doc")) | (F.col("start") != F.col("lead.start")))
    return settled.union(met.where("h1 is null").select("doc", "start", "stop")).union(late.select("doc", "start", "stop"))


def merged_spans(starts: list[int], stops: list[int]) -> list[tuple[int, int]]:
    """Byte spans covered by the windows from each start to its stop; adjoining ones are one."""
    out: list[list[int]] = []
    for a, b in sorted(zip(starts, stops, strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + SPAN)
        else:
            out.append([a, b + SPAN])
    return [(a, b) for a, b in out]


def _kept(texts: pa.Array, spans: pa.Array) -> pa.Array:
    rows = []
    for text, held in zip(texts, spans, strict=True):
        raw, held = (text.as_py() or "").encode(), held.as_py() or []
        cut, sha, at = merged_spans([x["start"] for x in held], [x["stop"] for x in held]), hashlib.sha256(), 0
        for a, b in cut:
            sha.update(raw[at:a])
            at = b
        sha.update(raw[at:])
        rows.append((len(raw), sum(b - a for a, b in cut), len(cut), sha.hexdigest(), [{"start": a, "stop": b} for a, b in cut]))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
    return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed byte spans of each document."""
    small_batches(docs.sparkSession)
    docs = _numbered(docs)
    spans = repeated_spans(docs).groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("held"))
    judge = F.arrow_udf(_kept, "struct<n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept_sha256:string,spans:array<struct<start:bigint,stop:bigint>>>")
    return docs.join(spans, "doc", "left").withColumn("_k", judge("text", "held")).select("doc_id", "_k.*")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document of documents without repeated 100-byte strings."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return without_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
