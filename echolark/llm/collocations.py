r"""Phrase collocation mining over count streams kept in prefix and in suffix order.

Counting reads the texts twice. The first pass sums 64-bit hashes of all words and phrases; those that
come to `least` or more set bits of a filter of FILTER_BITS at most, which never misses a phrase that is
frequent enough (hashes that meet only add to a sum). The second pass counts the phrases that the
filter lets through, as strings, so that counts are exact whatever the hashes do; a filter that is too
full for a corpus lets more through, and costs time only.

The counts then are two streams: one in prefix order (words from the left), one in suffix order (words
from the right). A phrase's beginnings and right extensions are neighbours in the first, its endings and
left extensions in the second, so merge joins that read two streams of one order in lockstep give every
left, right and extension count; nothing is looked up in a hash table. Hot words are rows of one key of
a merge join, which Spark's skew join splits.

Defined cases: null texts count as empty, a null language as `und`; only A-Z is lower-cased; a word is a
run of bytes other than space and tab within a piece, and pieces end at `.,;:!?`, \x0A-\x0D or the text's
end; repeated rows count each; equal scores are ordered by count, then by the phrase's bytes; texts of any
length are read in slices cut between pieces; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echolark.core import broadcast_if_small, scratch, small_batches, staged
from echolark.llm.textbytes import LOWER, SLICE_BYTES, mix, run_hashes

LONGEST = 3
#: Bits of the filter: so many for each phrase that passes, from the least to the most (32 MB).
FILTER_SPARE, FILTER_LEAST, FILTER_MOST = 16, 1 << 16, 1 << 28
#: What each byte is: of a word (0), between words (1), between pieces (2).
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
SALTS = 64
#: Phrases that are counted at once.
COMBINED = 4_000_000


@dataclass
class Words:
    """Words of a batch of texts: byte bounds in the lower-cased data, row, hash, and whether each starts a piece."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    hashes: np.ndarray
    opens: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)


def _cuts(kind: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Bounds of slices of about `size` bytes that end behind a byte between pieces, or at the end."""
    start, n = 0, len(kind)
    while start < n:
        stop = min(n, start + size)
        while stop < n:
            found = np.flatnonzero(kind[stop : stop + size] == 2)
            if len(found):
                stop += int(found[0]) + 1
                break
            stop = min(n, stop + size)
        yield start, stop
        start = stop


def words_of(texts: pa.Array) -> Words:
    texts = pc.fill_null(texts, "")
    _, where, what = texts.buffers()
    offsets = np.frombuffer(where, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = LOWER[np.frombuffer(what, np.uint8)[offsets[0] : offsets[-1]]] if what is not None and what.size else np.zeros(0, np.uint8)
    offsets -= offsets[0]
    kind = KIND[data]
    heads = np.zeros(len(data) + 1, bool)
    heads[offsets] = True
    found, pieces = [], 0
    for a, b in _cuts(kind, SLICE_BYTES):
        word, head = kind[a:b] == 0, heads[a:b]
        begins, closes = word.copy(), word.copy()
        begins[1:] &= ~word[:-1] | head[1:]
        closes[:-1] &= ~word[1:] | head[1:]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
        piece = np.cumsum((kind[a:b] == 2) | head) + pieces
        pieces = int(piece[-1]) + 1
        found.append((starts + a, ends + a, run_hashes(data[a:b], starts, ends), piece[starts]))
    starts, ends, hashes, piece = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else [()] * 4))
    row = np.searchsorted(offsets, starts, "right") - 1
    opens = np.ones(len(starts), bool)
    opens[1:] = piece[1:] != piece[:-1]
    return Words(data, starts, ends, row, hashes.astype(np.uint64), opens)


def phrase_hashes(words: Words, languages: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For 1 to LONGEST words, the place of each phrase's first word and the phrase's hash, which depends on its language."""
    if not len(words):
        return [(np.zeros(0, np.int64), np.zeros(0, np.uint64))] * LONGEST
    raw = [x.encode() + b"\0" for x in languages]
    ends = np.cumsum([len(x) for x in raw])
    of_language = run_hashes(np.frombuffer(b"".join(raw), np.uint8), np.append(0, ends[:-1]), ends)
    one = mix(words.hashes + of_language[words.row] * np.uint64(3))
    at, h = np.arange(len(words)), one
    out = [(at, h)]
    for n in range(2, LONGEST + 1):
        goes_on = at + n - 1 < len(words)
        at, h = at[goes_on], h[goes_on]
        inside = ~words.opens[at + n - 1]
        at, h = at[inside], h[inside]
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + one[at + n - 1])
        out.append((at, h))
    return out


def _named(batch: pa.RecordBatch) -> tuple[Words, list[str]]:
    column = batch.column(1)
    return words_of(column), batch.column(0).to_pylist()


def hashed_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, n) of the phrases of batches of (lang, text), summed over about COMBINED of them, so that a
    frequent phrase is a row or two of a task."""
    held: list[np.ndarray] = []

    def summed() -> pa.RecordBatch:
        found = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in found], names=["hash", "n"])

    for batch in batches:
        held += [h for _, h in phrase_hashes(*_named(batch))]
        if sum(map(len, held)) > COMBINED:
            yield summed()
    if held:
        yield summed()


class Filter:
    """Bits at two places of each hash that may be frequent."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(h: Column, size: int) -> list[Column]:
        """The bits that a hash sets in a filter of `size` of them, a power of two."""
        return [h.bitwiseAND(F.lit(size - 1)), F.shiftrightunsigned(h, 64 - (size.bit_length() - 1))]

    @classmethod
    def of(cls, hashes: DataFrame) -> Filter:
        """Of a staged table of hashes; what comes to the driver is the filter's words, bounded by FILTER_MOST."""
        size = FILTER_LEAST
        while size < min(FILTER_MOST, FILTER_SPARE * hashes.count()):
            size *= 2
        places = hashes.select(F.explode(F.array(*cls.places(F.col("hash"), size))).alias("at"))
        bit = F.expr("shiftleft(1L, cast(at & 63 as int))")
        words = places.groupBy(F.shiftright("at", 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
        bits = np.zeros(size // 64, np.int64)
        bits[words.column("at").to_numpy()] = words.column("bits").to_numpy()
        return cls(bits.view(np.uint64))

    def passes(self, h: np.ndarray) -> np.ndarray:
        n = np.uint64(64 * len(self.bits) - 1)
        shift = np.uint64(64 - int(n).bit_length())
        out = np.ones(len(h), bool)
        for place in (h & n, h >> shift):
            out &= (self.bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def word_names(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word of a batch, one for equal words of one hash, and the first place of each number.
    Bytes are compared, so words that only share a hash have different numbers."""
    _, first, name = np.unique(words.hashes, return_index=True, return_inverse=True)
    lengths = words.ends - words.starts
    likely = first[name]
    same = lengths == lengths[likely]
    for a in range(0, len(words), 1 << 16):
        k = np.arange(a, min(a + (1 << 16), len(words)))
        k = k[same[k]]
        size = lengths[k]
        before = np.cumsum(size) - size
        at = np.arange(int(size.sum())) - np.repeat(before, size)
        agree = words.data[at + np.repeat(words.starts[k], size)] == words.data[at + np.repeat(words.starts[likely[k]], size)]
        same[k] = np.logical_and.reduceat(agree, before) if len(k) else same[k]
    if same.all():
        return name, first
    names: dict[bytes, int] = {}
    name = np.array([names.setdefault(words.data[a:b].tobytes(), len(names)) for a, b in zip(words.starts, words.ends, strict=True)])
    return name, np.unique(name, return_index=True)[1]


def exact_counts(batches: Iterator[pa.RecordBatch], let: Filter) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, n) of the phrases that pass, and each language's number of words as that of the empty phrase."""
    for batch in batches:
        words, languages = _named(batch)
        kinds = {x: k for k, x in enumerate(dict.fromkeys(languages))}
        of_row = np.array([kinds[x] for x in languages], np.int64)
        lang, phrases, counts = [np.arange(len(kinds))], [pa.array([""] * len(kinds))], [np.bincount(of_row[words.row], minlength=len(kinds))]
        if len(words):
            name, first = word_names(words)
            spelled = pa.array([words.data[a:b].tobytes() for a, b in zip(words.starts[first], words.ends[first], strict=True)], pa.binary()).cast(pa.string())
            # key: a number for each different phrase of n words, by that of its first n - 1 and its last
            key, size = of_row[words.row] * len(first) + name, len(first)
            for n, (at, h) in enumerate(phrase_hashes(words, languages), 1):
                if n > 1:
                    _, short = np.unique(key[at], return_inverse=True)
                    key = np.zeros(len(words), np.int64)
                    key[at] = short * size + name[at + n - 1]
                at = at[let.passes(h)]
                _, where, times = np.unique(key[at], return_index=True, return_counts=True)
                at = at[where]
                lang.append(of_row[words.row[at]])
                counts.append(times)
                parts = [spelled.take(pa.array(name[at + k])) for k in range(n)]
                phrases.append(parts[0] if n == 1 else pc.binary_join_element_wise(*parts, " "))
        lang = pa.array(list(kinds), pa.string()).take(pa.array(np.concatenate(lang)))
        yield pa.RecordBatch.from_arrays([lang, pa.concat_arrays(phrases), pa.array(np.concatenate(counts).astype(np.int64))], names=["lang", "phrase", "n"])


def phrase_counts(docs: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, f), staged: phrases of 1 to LONGEST words found `least` times or more, and under
    the empty phrase the number of words of each language."""
    spark = docs.sparkSession
    small_batches(spark, "2m")
    texts = docs.select(F.coalesce(docs["lang"], F.lit("und")).alias("lang"), docs["text"].alias("text"))
    with scratch(spark):
        # summed before the shuffle by the batches, as most phrases are rare and a second sum there would gain little
        sums = texts.mapInArrow(hashed_counts, "hash long, n long").repartition("hash").groupBy("hash").agg(F.sum("n").alias("n"))
        let = spark.sparkContext.broadcast(Filter.of(staged(sums.where(F.col("n") >= least).select("hash"))))
        found = texts.mapInArrow(lambda it: exact_counts(it, let.value), "lang string, phrase string, n long")
        found = found.groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        return staged(found.where((F.col("f") >= least) | (F.col("phrase") == "")), keep=True)


def stream(counts: DataFrame, n: int, from_left: bool = True) -> DataFrame:
    """Phrases of n words with their words a (outermost first), f and the phrase: in prefix order as
    columns a1..an from the left, in suffix order from the right."""
    words = F.split("phrase", " ")
    at = range(n) if from_left else range(n - 1, -1, -1)
    of = counts.where((F.col("phrase") != "") & (F.size(words) == n))
    return of.select("lang", *[words[k].alias(f"a{i}") for i, k in enumerate(at, 1)], "phrase", "f")


def lockstep(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Two streams in the order of `keys`, read side by side."""
    return left.join(right.hint("merge"), keys, how)


def scored_phrases(counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score, longest) of every phrase of 2 to LONGEST words: its lowest-scoring cut,
    and the count of its most frequent extension by one word, which no longer one exceeds.

    A phrase meets its beginnings and right extensions in prefix order, its endings and left extensions
    in suffix order; then what both orders gave meets in the order of phrases."""
    out = None
    for n in range(2, LONGEST + 1):
        both = []
        for from_left, side in ((True, "l"), (False, "r")):
            rows, keys = stream(counts, n, from_left), ["lang", *[f"a{i}" for i in range(1, n + 1)]]
            for k in range(1, n):
                part = stream(counts, k, from_left).drop("phrase").withColumnRenamed("f", f"{side}{k if from_left else n - k}")
                rows = lockstep(rows, part, keys[: k + 1])
            if n < LONGEST:
                longer = stream(counts, n + 1, from_left).groupBy(keys).agg(F.max("f").alias(f"{side}x"))
                rows = lockstep(rows, longer, keys, "left")
            else:
                rows = rows.withColumn(f"{side}x", F.lit(None).cast("long"))
            both.append(rows.select("lang", "phrase", *(["f"] if from_left else []), *[f"{side}{k}" for k in range(1, n)], f"{side}x"))
        rows = lockstep(*both, ["lang", "phrase"])
        cuts = [F.struct(score(F.col("f"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, n)]
        rows = rows.select("lang", "phrase", F.col("f").alias("a"), F.array_min(F.array(*cuts)).alias("cut"), F.greatest("lx", "rx").alias("longest"))
        out = rows if out is None else out.union(rows)
    return out.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", "longest")


def score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000000 * a * a / (l * r)) in integers of 38 digits."""
    wide = [x.cast("decimal(19,0)") for x in (a, l, r)]
    above = F.lit(1_000_000).cast("decimal(7,0)") * (wide[0] * wide[0])
    return F.call_function("div", above.cast("decimal(38,0)"), (wide[1] * wide[2]).cast("decimal(38,0)")).cast("long")


def collocations(docs: DataFrame, least: int = 10, inside: int = 50, top: int = 2000) -> DataFrame:
    """Each language's `top` phrases of 2 to LONGEST words: lang, rank, phrase, a, l, r, n, score.

    Phrases count `least` times or more; those found inside a longer candidate that counts `inside` per
    cent of them or more are dropped."""
    spark = docs.sparkSession
    with scratch(spark):
        counts = phrase_counts(docs, least)
        free = scored_phrases(counts).where(F.col("longest").isNull() | (100 * F.col("longest") < inside * F.col("a")))
        order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
        # the first of each salt, then of these the first of each language, so that no window holds a language
        free = free.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
        free = free.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
        free = free.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
        totals = broadcast_if_small(counts.where("phrase = ''").select("lang", F.col("f").alias("n")))
        return staged(free.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), keep=True)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collocations of every language of documents."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


OP11_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, 1 AS k, unnest(ws) AS phrase FROM w UNION ALL
    SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w UNION ALL
    SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM w),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS v FROM f WHERE k > 1 AND f >= 10),
s AS (SELECT c.lang, c.phrase, c.f AS a, c.k, t.cut, l.f AS l, r.f AS r, CAST((1000000::HUGEINT * c.f * c.f) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
    FROM c JOIN (VALUES (1), (2)) t(cut) ON t.cut < c.k
    JOIN f l ON l.lang = c.lang AND l.k = t.cut AND l.phrase = array_to_string(c.v[1:t.cut], ' ')
    JOIN f r ON r.lang = c.lang AND r.k = c.k - t.cut AND r.phrase = array_to_string(c.v[t.cut + 1:c.k], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
x AS (SELECT lang, phrase, max(f) AS longest FROM (
    SELECT lang, array_to_string(v[1:2], ' ') AS phrase, f FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(v[2:3], ' '), f FROM c WHERE k = 3) GROUP BY ALL),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, encode(b.phrase)) AS rank
    FROM b LEFT JOIN x USING (lang, phrase) WHERE longest IS NULL OR 100 * longest < 50 * b.a)
SELECT o.lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000
"""
