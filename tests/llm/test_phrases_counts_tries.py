"""Collocations, token counts and conversation tries against plain Python on odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from echolark.llm import collocations, contraction, prefix_trie, token_counts

DOCS = "doc_id long, text string, lang string, phrase string, n long, digest string, key string, n_tokens string"


def texts():
    rng = random.Random(5)
    pool = ["the", "cat", "sat", "on", "a", "mat", "New", "york", "zürich", "ÄB", "x-1"]
    rows = [(1, None, "en"), (2, "", None), (3, " \t\n.,;", "en"), (4, "New York. new york", None)]
    for k in range(120):
        words = rng.choices(pool, weights=range(11, 0, -1), k=rng.randint(1, 40))
        rows.append((10 + k, "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ","]) for w in words), rng.choice(["en", "de", None])))
    rows += [rows[20]] * 3 + [(None, "the cat sat " * 30, "en"), (500, ("one two three " * 3000 + "! ") * 3, "de")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "p", 7, "d", "k", "t") for r in texts()], DOCS).repartition(3)


def best_phrases(rows, least=10, inside=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in (1, 2, 3):
                f[lang].update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            cuts = [(10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            longer = [c for q, c in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not any(100 * c >= inside * a for c in longer):
                found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_collocations(docs, spark):
    assert rows_of(collocations.collocations(docs)) == best_phrases(texts())
    assert rows_of(collocations.collocations(docs, least=3, inside=90, top=7)) == best_phrases(texts(), 3, 90, 7)
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_words_that_share_a_hash_are_told_apart(monkeypatch):
    column = pa.array(["aa bb aa. bb aa", None, "Bb aa bb"])
    monkeypatch.setattr(collocations, "run_hashes", lambda data, starts, ends: np.ones(len(starts), np.uint64))
    everything = collocations.Filter(np.full(1024, 2**64 - 1, np.uint64))
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "en", "de"]), column], names=["lang", "text"])
    (out,) = collocations.exact_counts(iter([batch]), everything)
    got = {(a, b): c for a, b, c in zip(*(x.to_pylist() for x in out.columns), strict=True)}
    assert got == {("en", ""): 5, ("de", ""): 3, ("en", "aa"): 3, ("en", "bb"): 2, ("de", "bb"): 2, ("de", "aa"): 1, ("en", "aa bb"): 1, ("en", "bb aa"): 2, ("de", "bb aa"): 1, ("de", "aa bb"): 1, ("en", "aa bb aa"): 1, ("de", "bb aa bb"): 1}


def test_slices_do_not_change_words(monkeypatch):
    column = pa.array([t for _, t, _ in texts()])
    whole = collocations.words_of(column)
    monkeypatch.setattr(collocations, "SLICE_BYTES", 50)
    cut = collocations.words_of(column)
    for name in ("starts", "ends", "row", "hashes", "opens"):
        assert (getattr(whole, name) == getattr(cut, name)).all(), name


def test_counts_beyond_64_bits_stay_exact(spark):
    a, b, c = 3 * 10**12 + 7, 4 * 10**12 + 1, 9 * 10**12 + 5
    got = spark.range(1).select(collocations.score(F.lit(a), F.lit(b), F.lit(c)).alias("s")).first().s
    assert got == 10**6 * a * a // (b * c)


def test_token_counts_and_the_cache(docs, spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    count = lambda t: len(library.encode(t or "", add_special_tokens=False))
    more = [(900, "a<|endoftext|>b <|endoftext|>"), (901, "日本 語。テスト ") , (902, "don't we'LL \x1c\x85\xa0 x"), (903, "the quick brown fox, don't. " * 60_000), (904, "日本語 " * 400_000), (None, None)]
    extra = spark.createDataFrame([(i, t, "en", "p", 7, "d", "k", "t") for i, t in more], DOCS)
    all_docs = docs.union(extra)
    cache = token_counts.TokenCache(spark, str(tmp_path), path)
    given = [(r[0], r[1]) for r in texts()] + more
    want = sorted(((i is not None, i or 0, len((t or "").encode()), count(t), count(t) > 512) for i, t in given))
    found = token_counts.with_token_counts(all_docs, cache)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in found.collect()) == want
    assert found.columns == ["doc_id", "text", "lang", "phrase", "n", "digest", "key", "n_bytes", "n_tokens", "over_limit"]
    assert {(r.digest, r.key) for r in found.collect()} == {("d", "k")}
    kept = spark.read.parquet(cache.path)
    assert kept.count() == kept.select("digest").distinct().count() == len({t or "" for _, t in given})
    digests = all_docs.select(token_counts.digest(F.col("text")).alias("digest"), token_counts.key_of(all_docs).alias("key"))
    assert cache.add_missing(all_docs, "text", digests) == 0  # warm
    again = token_counts.TokenCache(spark, str(tmp_path), path)
    assert again.counter.version == cache.counter.version and again.add_missing(all_docs.limit(0), "text", digests.limit(0)) == 0
    kept.limit(5).write.mode("append").parquet(cache.path)  # another run appended some of them too
    assert token_counts.with_token_counts(all_docs, cache).count() == len(given)
    other = token_counts.TokenCache(spark, str(tmp_path), public_tokenizers.path("piece_bpe_32k.model"))
    assert other.counter.version != cache.counter.version and other.add_missing(extra.where("doc_id < 903"), "text", digests.where("false")) == 0
    assert token_counts.with_token_counts(docs.limit(0), cache).count() == 0


def test_all_kinds_of_tokenizers_count_as_their_library(sf_dir):
    import public_tokenizers
    import pyarrow.parquet as pq
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    some = [t or "" for t in pq.read_table(f"{sf_dir}/documents.parquet").column("text").to_pylist()]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        library = Tokenizer.from_file(public_tokenizers.path(name))
        counter = token_counts.Counter(public_tokenizers.path(name))
        assert [counter.count(t) for t in some] == [len(library.encode(t, add_special_tokens=False)) for t in some]
    library = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    counter = token_counts.Counter(public_tokenizers.path("piece_bpe_32k.model"))
    assert [counter.count(t) for t in some] == [len(x) for x in library.encode(some)]


def trees():
    rng = random.Random(11)
    chain = [(k, 0, k - 1 if k else None) for k in range(90)]
    star = [(k, 0, 0 if k else None) for k in range(200)]
    caterpillar = [(k, 0, k - 1 if k else None) for k in range(40)] + [(100 + k, 0, k) for k in range(40)]
    forest = [(k, 0, None if k % 40 == 0 else rng.randrange(k - k % 40, k)) for k in range(160)]
    return {"chain": chain, "star": star, "caterpillar": caterpillar, "forest": forest, "one": [(0, 0, None)], "none": []}


@pytest.mark.parametrize("name", sorted(trees()))
def test_contraction(spark, name):
    nodes = trees()[name]
    depth = {}
    for k, _, p in nodes:
        depth[k] = 0 if p is None else depth[p] + 1
    total = {k: [1, k * 7] for k, *_ in nodes}
    for k, _, p in sorted(nodes, key=lambda x: -depth[x[0]]):
        if p is not None:
            total[p] = [a + b for a, b in zip(total[p], total[k])]
    rows = [(k, depth[k], p, None if p is None else depth[p], 1, k * 7) for k, _, p in nodes]
    df = spark.createDataFrame(rows, "node long, depth long, parent long, parent_depth long, size long, weight long")
    got = {r.node: [r.size, r.weight] for r in contraction.subtree_totals(df, ["size", "weight"], max(1, max(depth.values(), default=0).bit_length())).collect()}
    assert got == total


def test_contraction_refuses_a_cycle(spark):
    rows = [(0, 0, None, None, 1), (1, 1, 2, 2, 1), (2, 2, 1, 1, 1)]
    df = spark.createDataFrame(rows, "node long, depth long, parent long, parent_depth long, size long")
    with pytest.raises(ValueError, match="hang from no root"):
        contraction.subtree_totals(df, ["size"], 2).collect()


TURNS = "conv_id long, turn long, role string, text string, node string, depth string"


def turns():
    rng = random.Random(2)
    rows = []
    for c in [*range(0, 45), 63, 80, 81, 99, 1000003, 7_000_000_001]:
        n = rng.randint(1, 6)
        for t in range(n):
            text = rng.choice(["hello there", "how are  you", "", "x y z"]) if rng.random() < 0.7 else f"own words {rng.random()}"
            rows.append((c, None if rng.random() < 0.05 else t, rng.choice(["user", "assistant", None]), None if rng.random() < 0.05 else text))
    rows += [(120, k, "user", f"turn {k}") for k in range(60)] + [(121, k, "user", f"turn {k}") for k in range(60)]
    rows += rows[:5] + [(None, 0, "user", "nobody"), (140, 0, "user", "w " * 5000)]
    rows += [(161, k, "user", "only some") for k in range(1)]  # its donor is absent
    return rows


def plain_trie(rows):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", sha(text or ""), text or ""))
    own = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children, leaves, saved = Counter(p[:-1] for p in members if p), Counter(), Counter()
    for p in members:
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(members[p]) - 1) * words
    out = []
    for p, cs in members.items():
        ends = sha(",".join(map(str, sorted(c for c in cs if len(built[c]) == len(p)))))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else -1, len(cs), children[p], leaves[p], saved[p], ends))
    return sorted(out)


@pytest.mark.parametrize("stretch", [1024, 7])
def test_trie(spark, monkeypatch, stretch):
    monkeypatch.setattr(prefix_trie, "STRETCH", stretch)
    monkeypatch.setattr(prefix_trie, "MEMBERS", stretch)
    df = spark.createDataFrame([(*r, "clash", "clash") for r in turns()], TURNS).repartition(4)
    got = sorted((*(-1 if x is None else x for x in r[:7]), r[7]) for r in map(tuple, prefix_trie.conversation_trie(df).collect()))
    assert got == plain_trie(turns())


def test_trie_of_nothing(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], TURNS)).count() == 0
    assert prefix_trie.conversation_trie(spark.createDataFrame([(None, 1, "a", "b", "", "")], TURNS)).count() == 0
