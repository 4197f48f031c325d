"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one resolves whole pre-tokens that are in the vocabulary by a minimal perfect hash: one slot
per vocabulary entry, no collisions, the slot's bytes confirm the match. Tier two encodes misses by
a heap of adjacent pairs over a linked list of bytes, lowest rank first and leftmost among equals,
in O(n log n) for a pre-token of n bytes. Results of both are kept in a bounded memo per worker.
The tables are built on the driver from a rank file and broadcast; MAX_VOCABULARY bounds them.

Defined cases: a null text counts as empty and encodes to no ids; special tokens are plain text;
texts of any length are encoded piece by piece without holding all ids; repeated rows and rows of null
ids are encoded alike; other columns pass through, but those named like a result give way to it; an
empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echolark.core import field, own_columns, small_batches
from echolark.llm.textbytes import mix, run_hashes

#: Letters of the plainer pattern, and what it is not used on.
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
OTHER = re.compile(rf"[^\x00-\x1b\x20-\x7e{LATIN}]")
MAX_VOCABULARY = 1_000_000
MEMO_ENTRIES = 300_000
PIECE = 16_384
BLOCK = 1 << 19


class PerfectHash:
    """Minimal perfect hash by displacement: a bucket's displacement sends its keys to free slots;
    buckets of one key name their slot outright (as -1 - slot)."""

    def __init__(self, hashes: np.ndarray):
        n = max(1, len(hashes))
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two vocabulary entries share a 64-bit hash")
        self.n, self.buckets = n, max(1, n // 2)
        self.displacement = np.zeros(self.buckets, np.int64)
        self.slot_key = np.full(n, -1, np.int64)
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []
        free = np.ones(n, bool)
        for keys in sorted(groups, key=len, reverse=True):
            if len(keys) == 1:
                break
            d, slots = self._placed(hashes[keys], free)
            free[slots] = False
            self.slot_key[slots] = keys
            self.displacement[bucket[keys[0]]] = d
        open_slots = iter(np.flatnonzero(free).tolist())
        for keys in groups:
            if len(keys) == 1:
                slot = next(open_slots)
                self.slot_key[slot] = keys[0]
                self.displacement[bucket[keys[0]]] = -1 - slot

    def _slots(self, hashes: np.ndarray, d: np.ndarray) -> np.ndarray:
        return (mix(hashes ^ (np.asarray(d).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) % np.uint64(self.n)).astype(np.int64)

    def _placed(self, hashes: np.ndarray, free: np.ndarray) -> tuple[int, np.ndarray]:
        """The first displacement that sends all of a bucket to different free slots; tried in growing blocks."""
        d, block = 1, 8
        while d < 1 << 24:
            slots = self._slots(hashes[None, :], np.arange(d, d + block)[:, None])
            for k in np.flatnonzero(free[slots].all(axis=1)).tolist():
                if len(set(slots[k].tolist())) == len(hashes):
                    return d + k, slots[k]
            d, block = d + block, min(2 * block, 4096)
        raise ValueError("no displacement found")

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """The only key that each hash can be, or -1."""
        d = self.displacement[(hashes % np.uint64(self.buckets)).astype(np.int64)]
        return self.slot_key[np.where(d < 0, -1 - d, self._slots(hashes, d))]


def hashes_of(keys: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(k) for k in keys]) if keys else np.zeros(0, np.int64)
    return run_hashes(np.frombuffer(b"".join(keys), np.uint8), np.concatenate([[0], ends[:-1]]).astype(np.int64) if keys else ends, ends)


class Tokenizer:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if len(ranks) > MAX_VOCABULARY:
            raise ValueError(f"{len(ranks)} entries exceed the broadcast bound of {MAX_VOCABULARY}")
        self.ranks, self.pattern = ranks, pattern
        self.keys = list(ranks)
        self.ids = list(ranks.values())
        self.table = PerfectHash(hashes_of(self.keys))
        self.pairs = np.full(1 << 16, -1, np.int64)
        for key, i in ranks.items():
            if len(key) == 2:
                self.pairs[key[0] << 8 | key[1]] = i
        self.pieces = [b""] * (max(self.ids, default=-1) + 1)
        for key, i in ranks.items():
            self.pieces[i] = key
        self._ready()

    def _ready(self) -> None:
        #: What each pre-token met so far comes to: its ids in decimal, and the bytes that these ids stand for.
        self.decimal: dict[str, str] = {}
        self.spelled: dict[str, bytes] = {}
        self.old: tuple[dict[str, str], dict[str, bytes]] = ({}, {})
        self.split = regex.compile(self.pattern)
        plain = self.pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{LATIN}0-9]").replace(r"\p{L}", f"[{LATIN}]").replace(r"\p{N}", "[0-9]")
        self.quick = re.compile(plain) if r"\p" not in plain else None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("decimal", "spelled", "old", "split", "quick")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._ready()

    @classmethod
    def from_file(cls, path: str, pattern: str) -> Tokenizer:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern)

    def merged(self, word: bytes, firsts: list[int]) -> tuple[int, ...]:
        """Ids of one pre-token by merging linked bytes, lowest rank first. The heap holds rank, place
        and width of each pair as one number; `firsts` are the ranks of the pairs of single bytes."""
        ranks, n = self.ranks.get, len(word)
        bits = n.bit_length()
        high, low = 2 * bits, (1 << bits) - 1
        after, before, size = list(range(1, n + 1)), list(range(-1, n - 1)), [1] * n
        heap = [r << high | i << bits | 2 for i, r in enumerate(firsts) if r >= 0]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            top = pop(heap)
            i, width = top >> bits & low, top & low
            if not size[i] or (j := after[i]) >= n or size[i] + size[j] != width:
                continue
            size[i], size[j] = width, 0
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := ranks(word[i : k + size[k]])) is not None:
                    push(heap, r << high | i << bits | width + size[k])
            h = before[i]
            if h >= 0 and (r := ranks(word[h : i + width])) is not None:
                push(heap, r << high | h << bits | size[h] + width)
        rank = self.ranks
        return tuple([rank[word[i : i + z]] for i, z in enumerate(size) if z])

    def ids_of(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of pre-tokens: by the perfect hash where it has them, else by merging."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        found = self.table.lookup(hashes_of(raw)).tolist()
        out = [(self.ids[k],) if k >= 0 and self.keys[k] == key else None for key, k in zip(raw, found, strict=True)]
        misses = [i for i, ids in enumerate(out) if ids is None]
        data = np.frombuffer(b"".join([raw[i] for i in misses]) + b"\0", np.uint8).astype(np.int64)
        firsts, at = self.pairs[data[:-1] << 8 | data[1:]].tolist(), 0
        for i in misses:
            word = raw[i]
            out[i] = self.merged(word, firsts[at : at + len(word) - 1])
            at += len(word)
        return out

    def learn(self, tokens: Iterable[str]) -> None:
        """Puts the tokens that are new into the memo. When it is full it becomes the old one, from
        which words that come again are taken over, so that frequent ones stay."""
        if not (new := list(set(tokens).difference(self.decimal))):
            return
        if len(self.decimal) + len(new) > MEMO_ENTRIES:
            self.old = (self.decimal, self.spelled)
            self.decimal, self.spelled = {}, {}
            new = list(set(tokens))
        decimal, spelled = self.old
        for word in [w for w in new if w in decimal]:
            self.decimal[word], self.spelled[word] = decimal[word], spelled[word]
        new = [w for w in new if w not in decimal]
        for word, ids in zip(new, self.ids_of(new), strict=True):
            self.decimal[word] = ",".join(map(str, ids))
            self.spelled[word] = self.decode(ids)

    def tokens(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text, all at once or, of long ones, PIECE at a time. A plainer pattern,
        equal on the letters of LATIN, is twice as fast."""
        split = self.quick if self.quick and not OTHER.search(text) else self.split
        if len(text) <= 4 * PIECE:
            yield split.findall(text)
            return
        matches = (m.group() for m in split.finditer(text))
        while tokens := list(islice(matches, PIECE)):
            yield tokens

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for tokens in self.tokens(text):
            self.learn(tokens)
            for word in tokens:
                out.extend(map(int, self.decimal[word].split(",")))
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))

    def digests(self, texts: Iterable[str]) -> Iterator[tuple[int, str, str]]:
        """Of each text, the number of ids, SHA-256 of the ids in decimal, SHA-256 of what they decode
        to. New pre-tokens of BLOCK characters of text, or of one piece, are looked up at once."""
        block, size = [], 0
        for text in texts:
            if len(text) > 4 * PIECE:
                yield from self._of_block(block)
                yield self._of_pieces(self.tokens(text))
                block, size = [], 0
                continue
            block.append(next(self.tokens(text)))
            size += len(text)
            if size > BLOCK:
                yield from self._of_block(block)
                block, size = [], 0
        yield from self._of_block(block)

    def _of_block(self, block: list[list[str]]) -> Iterator[tuple[int, str, str]]:
        self.learn(set().union(*block))
        for tokens in block:
            ids = ",".join(map(self.decimal.__getitem__, tokens)).encode()
            text = b"".join(map(self.spelled.__getitem__, tokens))
            yield ids.count(b",") + 1 if ids else 0, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()

    def _of_pieces(self, pieces: Iterable[list[str]]) -> tuple[int, str, str]:
        n, ids_sha, text_sha = 0, hashlib.sha256(), hashlib.sha256()
        for tokens in pieces:
            self.learn(tokens)
            ids = ",".join(map(self.decimal.__getitem__, tokens)).encode()
            ids_sha.update(b"," + ids if n else ids)
            n += ids.count(b",") + 1
            text_sha.update(b"".join(map(self.spelled.__getitem__, tokens)))
        return n, ids_sha.hexdigest(), text_sha.hexdigest()


def shared_tokenizer(spark: SparkSession, path: str, pattern: str):
    return spark.sparkContext.broadcast(Tokenizer.from_file(path, pattern))


def encoded(tokenizer, text: Column) -> Column:
    """The ids of a text as array<int>."""

    @F.arrow_udf("array<int>")
    def encode(column: pa.Array) -> pa.Array:
        return pa.array((tokenizer.value.encode(x.as_py() or "") for x in column), pa.list_(pa.int32()))

    return encode(text)


def decoded(tokenizer, ids: Column) -> Column:
    """The bytes that ids stand for; null ids count as none."""

    @F.arrow_udf("binary")
    def decode(column: pa.Array) -> pa.Array:
        return pa.array((tokenizer.value.decode(x.as_py() or []) for x in column), pa.binary())

    return decode(ids)


def digested(tokenizer, text: Column) -> Column:
    """struct<n_tokens, ids_sha256, decoded_sha256> of a text's ids."""

    @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
    def digest(column: pa.Array) -> pa.Array:
        found = list(tokenizer.value.digests(x.as_py() or "" for x in column))
        return pa.StructArray.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))], names=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digest(text)


def public_tokenizer(spark: SparkSession, name: str = "byte_bpe_multi_50k.tiktoken"):
    import public_tokenizers

    return shared_tokenizer(spark, public_tokenizers.path(name), public_tokenizers.PATTERN)


def tokenised(docs: DataFrame, tokenizer=None) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256."""
    small_batches(docs.sparkSession)
    tokenizer = tokenizer or public_tokenizer(docs.sparkSession)
    given = docs.select(own_columns(docs), digested(tokenizer, docs["text"]).alias("found"))
    names = ("n_tokens", "ids_sha256", "decoded_sha256")
    return given.select(*[field("doc", c) for c in docs.columns if c.lower() not in names], *[f"found.{k}" for k in names])


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding and decoding of every whole text of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return tokenised(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
