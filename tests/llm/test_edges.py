"""Odd tables for every operator of texts and pages: repeated rows, null ids, clashing names, empty tables; Viterbi against all taggings."""

import itertools
import random

import pytest

from echolark.llm import byte_bpe, exact_dedup, mixing, near_dedup, pii_surrogates, quality_rules, secret_scan, substring_dedup, toxicity, url_filter

CLASH = ["row", "doc", "found", "found_", "stats", "judged", "key", "dealt", "n", "k1", "sig", "label", "known", "any", "digests", "s"]
SCHEMA = "doc_id long, text string, source string, url string, " + ", ".join(f"`{c}` string" for c in CLASH)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    prose = " ".join("".join(rng.choices("abcdefg", k=5)) for _ in range(60))
    rows = [(None, prose), (None, None), (1, prose), (1, prose), (2, ""), (3, "Mrs. Erica Long, mail a@b.org, token = \"abcdef12\""), (3, "Mrs. Erica Long, mail a@b.org, token = \"abcdef12\""), (4, "Ünï ÇÖDE " * 4000)]
    rows = [(i, t, "s", f"http://a.org/{i}", *(f"{c}!" for c in CLASH)) for i, t in rows]
    return spark.createDataFrame(rows, SCHEMA)


def applied(spark, docs):
    """Each operator's result on docs, with the columns that pass through."""
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    field = secret_scan.Field({}, [[0.0] * 3] * 3)
    yield "quality", quality_rules.kept_documents(docs, labels), CLASH
    yield "statistics", quality_rules.judged(docs, labels), [c for c in CLASH]
    yield "secrets", secret_scan.scanned(docs, field), CLASH
    yield "toxicity", toxicity.scored(docs, toxicity.fit(docs, labels)), CLASH
    yield "tokens", byte_bpe.tokenised(docs), CLASH
    yield "copies", exact_dedup.drop_copies(docs), CLASH
    yield "near copies", near_dedup.drop_near_copies(docs), CLASH
    yield "surrogates", pii_surrogates.with_surrogates(docs, "k"), CLASH
    yield "urls", url_filter.filter_urls(docs, url_filter.RULES), CLASH
    yield "mix", mixing.mixed_documents(docs), CLASH


def test_odd_rows_and_names(spark, odd):
    counts = {"quality": None, "copies": 4, "near copies": 5, "mix": None}
    for name, out, through in applied(spark, odd):
        rows = out.collect()
        assert rows and all(r[c] == f"{c}!" for r in rows for c in through), name
        if counts.get(name, 8) is not None:
            assert len(rows) == counts.get(name, 8), name
        seen = {}
        for r in (r for r in rows if r.doc_id is not None):  # rows that are alike come out alike
            seen.setdefault((r.doc_id, None if name == "surrogates" else r.text), set()).add(tuple(map(str, r)))
        assert name == "mix" or all(len(x) == 1 for x in seen.values()), name


def test_empty_tables(spark, odd):
    for name, out, _ in applied(spark, odd.limit(0)):
        assert out.count() == 0, name


def test_repeats_with_null_ids(spark):
    text = "x" * 60 + "y" * 60 + "z" * 60
    rows = spark.createDataFrame([(None, text), (None, text), (1, text), (1, "short")], "doc_id long, text string")
    out = sorted((r.n_removed, r.n_bytes, r.doc_id is None) for r in substring_dedup.without_repeats(rows).collect())
    assert out == [(0, 5, False), (0, 180, True), (180, 180, False), (180, 180, True)]


def test_viterbi_is_the_best_of_all_taggings():
    rng = random.Random(8)
    never = secret_scan.NEVER
    for _ in range(60):
        n = rng.randint(1, 6)
        t = [[rng.uniform(-2, 2) for _ in range(3)] for _ in range(3)]
        t[secret_scan.O][secret_scan.I] = never
        e = [[rng.uniform(-3, 3) for _ in range(3)] for _ in range(n)]
        field = secret_scan.Field({}, t)

        def score(tags):
            return sum(e[k][y] for k, y in enumerate(tags)) + sum(t[a][b] for a, b in zip(tags, tags[1:])) + (never if tags[0] == secret_scan.I else 0)

        best = max(itertools.product(range(3), repeat=n), key=score)
        assert score(field.viterbi(e)) == pytest.approx(score(best))


def test_labels_held_out_are_not_read(spark):
    import zlib

    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows = [(k, " ".join([word() for _ in range(20)] + (["worthless", "scumbag"] if k % 3 == 0 else []))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    right = [(k, int(k % 3 == 0)) for k in range(300)]
    turned = [(k, 1 - y if zlib.crc32(str(k).encode()) % 3 == 1 else y) for k, y in right]
    scores = []
    for labels in (right, turned):
        scorer = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        scores.append({r.doc_id: r.score for r in toxicity.scored(docs, scorer).collect()})
    assert scores[0] == scores[1] and all(0 <= x <= 1 for x in scores[0].values())


def test_whole_texts_of_sf001_are_tokenised_as_by_the_library(sf_dir):
    import base64
    import hashlib

    import public_tokenizers
    import pyarrow.parquet as pq
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = byte_bpe.Tokenizer(ranks, public_tokenizers.PATTERN)
    texts = [t or "" for t in pq.read_table(f"{sf_dir}/documents.parquet").column("text").to_pylist()]
    texts += [" ab cd," * (5 * byte_bpe.PIECE), "x" * 70_000 + " 日本" * byte_bpe.PIECE, "", "Ω"]
    for text, (n, ids_sha, text_sha) in zip(texts, own.digests(texts), strict=True):
        ids = library.encode_ordinary(text)
        assert (n, ids_sha) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert text_sha == hashlib.sha256(text.encode()).hexdigest()
