"""Token counts through a cache of digests.

A cache is a folder of tables, one for each tokenizer version: the SHA-256 of the tokenizer's file, the
library and its version. A row is the SHA-256 of a content and its number of tokens. Counting a table of
documents digests each text, leaves out digests that the cache has, encodes one text of each that is
missing, appends their counts, and joins the cache back. Texts move only if more of them are missing than
may be broadcast; then those rows are joined by digest once.

Two runs may append the same digest; a reader takes it once, as both have one count. An append that fails
leaves nothing, since Spark's committer publishes whole tables; run again, it finds what is still missing.

Counting is the library's. Of byte-level BPE without a normaliser, texts of plain Latin letters without a
special token are split by the tokenizer's own pattern, and the library is asked once for the count of each
different pre-token: pre-tokens are encoded separately, so counts add up. All other texts go to the library
whole or, when long, cut where no token can cross.

Defined cases: a null text counts as empty, an empty one has no tokens; special strings inside texts are
one token each, as the library has it; repeated rows and rows of null ids are counted alike; texts of any
length are read whole; other columns pass through, but those named like a result give way to it; an empty
table gives an empty result and appends nothing.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from importlib.metadata import version
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echolark.core import broadcast_if_small, field, own_columns, scratch, shared_dir, small_batches, staged

LIMIT = 512
#: Pre-tokens whose counts a worker keeps, those of a long text read at once, and characters of a part of a long text.
MEMO_ENTRIES, PIECE, PART = 300_000, 16_384, 1 << 20
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Beyond these characters the plain pattern may differ from the library's.
OTHER = re.compile(rf"[^\x00-\x1b\x20-\x7e{LATIN}]")
#: How byte-level BPE splits plain Latin texts (a fixed value of its pre-tokenizer).
PLAIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^\s{LATIN}0-9]+|\s+(?!\S)|\s+")
#: Between a letter and a space with a letter behind it no pre-token goes on, nor behind a stop before a letter.
SEAM = re.compile(r"(?<=[a-zà-öø-ÿа-я])(?= [a-zà-öø-ÿа-я])|(?<=[.,;:!?。，、])(?=[a-zà-öø-ÿа-я一-龥])", re.IGNORECASE)


class Counter:
    """Numbers of tokens of texts by a tokenizer file: .json of tokenizers, .model of sentencepiece."""

    def __init__(self, path: str):
        self.path = path
        with open(path, "rb") as f:
            self.content = f.read()
        self.library = "tokenizers" if path.endswith(".json") else "sentencepiece"
        self.version = hashlib.sha256(b"\0".join([hashlib.sha256(self.content).digest(), self.library.encode(), version(self.library).encode()])).hexdigest()
        self._ready()

    def _ready(self) -> None:
        self.counts: dict[str, int] = {}
        self.specials, self.plain, self.seams = re.compile(r"(?!)"), False, False
        if self.library == "sentencepiece":
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_proto=self.content)
            self.whole = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            return
        from tokenizers import Tokenizer

        model = Tokenizer.from_str(self.content.decode())
        model.no_padding()
        model.no_truncation()
        self.whole = lambda texts: [len(model.encode(x, add_special_tokens=False)) for x in texts]
        told = json.loads(self.content)
        added = [x["content"] for x in told.get("added_tokens") or []]
        if added:
            self.specials = re.compile("|".join(map(re.escape, added)))
        split = told.get("pre_tokenizer") or {}
        bpe = told["model"].get("type") == "BPE" and not told["model"].get("dropout") and not told["model"].get("continuing_subword_prefix")
        self.plain = bpe and not told.get("normalizer") and split.get("type") == "ByteLevel" and bool(split.get("use_regex")) and not split.get("add_prefix_space")
        self.seams = self.plain and not any(map(SEAM.search, added))

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("path", "content", "library", "version")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._ready()

    def count(self, text: str) -> int:
        if self.plain and not OTHER.search(text) and not self.specials.search(text):
            return sum(map(self._of_pretokens, self._pretokens(text)))
        return sum(self.whole(list(self._parts(text))))

    def _pretokens(self, text: str) -> Iterator[list[str]]:
        if len(text) <= 4 * PIECE:
            yield PLAIN.findall(text)
            return
        found = (m.group() for m in PLAIN.finditer(text))
        while some := list(islice(found, PIECE)):
            yield some

    def _of_pretokens(self, found: list[str]) -> int:
        if new := list(set(found).difference(self.counts)):
            if len(self.counts) + len(new) > MEMO_ENTRIES:
                self.counts = {}
                new = list(set(found))
            self.counts.update(zip(new, self.whole(new), strict=True))
        return sum(map(self.counts.__getitem__, found))

    def _parts(self, text: str) -> Iterator[str]:
        """The text, or parts of PART characters or more that are encoded as they would be within it."""
        at = 0
        while self.seams and len(text) - at > PART and (seam := SEAM.search(text, at + PART)):
            yield text[at : seam.start()]
            at = seam.start()
        yield text[at:]


def counted(counter, text: Column) -> Column:
    """The number of tokens of a text, by a broadcast Counter."""

    @F.arrow_udf("bigint")
    def count(column: pa.Array) -> pa.Array:
        return pa.array((counter.value.count(x.as_py() or "") for x in column), pa.int64())

    return count(text)


def digest(text: Column) -> Column:
    """SHA-256 of a content: of its UTF-8 bytes, null being none. No bytes are dropped or folded, as each may change a count."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


class TokenCache:
    """Counts by digest of one tokenizer version under `folder`, which driver and executors share."""

    SCHEMA = "digest binary, n_tokens long"

    def __init__(self, spark: SparkSession, folder: str, tokenizer: str):
        self.spark, self.counter = spark, Counter(tokenizer)
        self.path = f"{folder}/version-{self.counter.version}"
        self.shared = spark.sparkContext.broadcast(self.counter)
        where = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))

    def add_missing(self, docs: DataFrame, text: str, digests: DataFrame) -> int:
        """Counts one text of each digest that the cache has not, and appends; returns how many were missing.
        `digests`, staged, has the digest and the number `key` of each row of docs' texts."""
        with scratch(self.spark):
            first = digests.groupBy("digest").agg(F.min("key").alias("key"))
            missing = staged(first.join(self.read(), "digest", "left_anti"))
            if n := missing.count():
                # rows of one content and one key are equal texts: any of them will do
                texts = docs.select(digest(docs[f"`{text}`"]).alias("digest"), key_of(docs).alias("key"), docs[f"`{text}`"].alias("text"))
                one = texts.join(broadcast_if_small(missing), ["digest", "key"])
                found = one.select("digest", counted(self.shared, F.col("text")).alias("n_tokens"))
                found.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens")).write.mode("append").parquet(self.path)
            return n


def key_of(docs: DataFrame) -> Column:
    """A number that tells rows of one content apart: a hash of the columns that are not the text's, so that
    the rows are the same whenever they are read. Rows that it does not tell apart are counted more than once."""
    ids = [docs[f"`{c}`"] for c in docs.columns if c.lower() == "doc_id"]
    return F.xxhash64(*ids) if ids else F.lit(0).cast("long")


def with_token_counts(docs: DataFrame, cache: TokenCache, text: str = "text", limit: int = LIMIT, keep_text: bool = True) -> DataFrame:
    """docs (without the text, if that is not kept) with n_bytes, n_tokens and over_limit (more tokens than `limit`)."""
    small_batches(docs.sparkSession)
    content = docs[f"`{text}`"]
    digests = staged(docs.select(digest(content).alias("digest"), key_of(docs).alias("key")))
    cache.add_missing(docs, text, digests)
    names = ("n_bytes", "n_tokens", "over_limit")
    given = docs.select(own_columns(docs, but=() if keep_text else (text,)), digest(content).alias("digest"), F.coalesce(F.octet_length(content), F.lit(0)).cast("long").alias("n_bytes"))
    wanted = digests.select("digest").distinct()
    counts = broadcast_if_small(staged(cache.read().join(wanted, "digest", "left_semi")))
    found = given.join(counts, "digest", "left")
    return found.select(*[field("doc", c) for c in docs.columns if c.lower() not in names and (keep_text or c != text)], "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document, through a cache of its own that is empty at first."""
    import public_tokenizers

    cache = TokenCache(spark, f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}", public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_token_counts(docs, cache, keep_text=False).select("doc_id", "n_bytes", "n_tokens", "over_limit")
