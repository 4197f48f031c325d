"""The pipeline's stages, each and together, against plain Python on a small corpus with odd rows."""

import base64
import hashlib
import os
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from echolark.core import holding, release
from echolark.llm import quality_rules

#: doc_id, text and source, and columns whose names the operators use for themselves or their results.
NAMES = ["row", "kept", "n_words", "size", "target", "text_sha256", "keep_id", "component_id", "stats", "n"]
SCHEMA = "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in NAMES)


def texts():
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 8)))
    base = [word() for _ in range(90)]
    rows = [(None, " ".join(base[:30]), "a"), (1, None, "a"), (2, "", "b"), (3, " \n\t", None), (4, "too short", "a"), (5, "again and " * 60, "b"), (6, " ".join(word() for _ in range(9000)), "b")]
    for k in range(10, 60):
        rows.append((k, " ".join(word() for _ in range(rng.randint(12, 80))), "abc"[k % 3]))
    rows += [(60, rows[10][1], "a"), (61, rows[10][1].upper(), "b"), (62, rows[10][1], "a"), (62, rows[10][1], "a")]
    for k in range(70, 95):
        copy = list(base)
        for _ in range(k % 5):
            copy[rng.randrange(90)] = word()
        rows.append((k, " ".join(copy), "c"))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *(f"{c} {r[0]}" for c in NAMES)) for r in texts()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory, docs):
    """A folder with the tables that the pipeline reads: no document is labelled bad but the base rule's."""
    at = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(10, 40)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def lower(t):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), t or "")


def good(rows):
    out = []
    for r in rows:
        w = words(r[1])
        at = {}
        for i in range(len(w) - 4):
            at.setdefault(tuple(w[i : i + 5]), []).append(i)
        repeated = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 5)}
        if len(w) >= 10 and 100 * len(repeated) <= 20 * len(w):
            out.append(r)
    return out


def without_copies(rows):
    best = {}
    for r in rows:
        key = lower(r[1])
        if key not in best or (r[0] is not None and (best[key][0] is None or r[0] > best[key][0])):
            best[key] = r
    return list(best.values())


def without_near(rows):
    sets = []
    for r in rows:
        w = words(lower(r[1]))
        sets.append(set(zip(*(w[k:] for k in range(5)))) if len(w) > 4 else {tuple(w)} if w else set())
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group[root(i)] = root(j)
    classes = {}
    for i, r in enumerate(rows):
        classes.setdefault(root(i) if sets[i] else (i,), []).append(r)
    return [min(rs, key=lambda r: (r[0] is None, r[0] or 0)) for rs in classes.values()]


def plain(df):
    """Rows as (id, text, source); the clashing columns must have come through."""
    assert df.columns == ["doc_id", "text", "source", *NAMES]
    rows = df.collect()
    assert all(r[c] == f"{c} {r.doc_id}" for r in rows for c in NAMES)
    return [(r.doc_id, r.text, r.source) for r in rows]


def key(rows):
    return sorted(rows, key=str)


def test_quality_keeps_what_the_base_rule_passes(spark, docs, sf):
    assert key(plain(corpus_pipeline.quality(spark, docs, sf))) == key(good(texts()))


def test_exact_keeps_one_of_equal_texts(spark, docs, sf):
    assert key(plain(corpus_pipeline.exact(spark, docs, sf))) == key(without_copies(texts()))


def test_near_keeps_the_smallest_id_of_each_class(spark, docs, sf):
    # rows of one id and text stay once
    assert key(plain(corpus_pipeline.near(spark, docs, sf))) == key(without_near(texts()))


def test_mix_reaches_the_targets(spark, docs, sf):
    out = plain(corpus_pipeline.mix(spark, docs, sf))
    given, sizes = {}, {}
    for i, t, s in texts():
        given.setdefault((i, s), set()).add(t)
        sizes[s] = sizes.get(s, 0) + len(words(t))
    taken = {}
    for i, t, s in out:
        assert words(t) and any(x and x.startswith(t) for x in given[i, s])
        taken[s] = taken.get(s, 0) + len(words(t))
    budget, order = sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, s))
    goal, free, left = {}, dict(zip(order, [5, 2, 1] * len(order))), budget
    while True:
        share = {s: left * w / sum(free.values()) for s, w in free.items()}
        full = [s for s in free if share[s] >= 3 * sizes[s]]
        if not full:
            goal |= share
            break
        for s in full:
            goal[s] = 3 * sizes[s]
            left -= goal[s]
            del free[s]
    assert sum(taken.values()) == budget and all(abs(taken.get(s, 0) - goal[s]) <= 2 for s in goal)


def test_tokens_are_the_librarys(spark, docs, sf):
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = []
    for i, t, s in texts():
        ids = library.encode_ordinary(t or "")
        expected.append((i, s, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert key(map(tuple, corpus_pipeline.tokens(spark, docs, sf).collect())) == key(expected)


def test_the_whole_pipeline(spark, sf):
    left = without_near(without_copies(good(texts())))
    out = corpus_pipeline.run(spark, sf).collect()
    assert {(r.doc_id, r.source) for r in out} <= {(i, s) for i, _, s in left} and len(out) >= len(left) // 2
    assert [r.decoded_sha256 for r in out if r.doc_id == 6]


def test_stages_compose_without_being_written(spark, docs, sf):
    paths = []
    with holding(paths):
        first = docs
        for _, stage in corpus_pipeline.STAGES[:3]:
            first = stage(spark, first, sf)
        left = without_near(without_copies(good(texts())))
        assert key(plain(first)) == key(left)
        mixed = corpus_pipeline.mix(spark, first, sf)
        other = corpus_pipeline.exact(spark, docs, sf)  # another pipeline, in the same thread
        again = corpus_pipeline.mix(spark, other, sf)
        counted = corpus_pipeline.tokens(spark, mixed, sf)
        assert counted.count() == mixed.count() and again.count() > 0
        assert key(plain(other)) == key(without_copies(texts()))
        assert key(plain(first)) == key(left)
    at = [p.removeprefix("file://") for p in paths]
    assert at and all(os.path.isdir(p) for p in at)
    release(spark, paths)
    assert not any(os.path.exists(p) for p in at)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_empty_tables(spark, docs, sf, stage):
    out = stage(spark, docs.limit(0), sf)
    assert out.count() == 0 and (stage is corpus_pipeline.tokens or out.columns == docs.columns)


def test_a_learned_rule_rejects(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rows = [(k, " ".join(("#### " if k % 4 == 0 else "") + word() for _ in range(30))) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 != 0)) for k in range(0, 400, 2)], "doc_id long, quality int")
    kept = {r.doc_id for r in quality_rules.kept_documents(docs, labels).collect()}
    assert kept == {k for k in range(400) if k % 4}
    one_kind = labels.where("quality = 1")
    assert quality_rules.kept_documents(docs, one_kind).count() == 400


def test_a_condition_that_another_implies_goes():
    c = quality_rules.Condition
    rule = (c("x", True, 0.2), c("y", False, 3.0), c("x", True, 0.5), c("x", False, 0.9))
    assert quality_rules.simplified(rule) == rule[1:]


def test_symbols_are_counted(spark):
    rows = [(1, "a #*$%&|<> b ~^"), (2, None), (3, "##")]
    out = {r.doc_id: r.n_symbols for r in quality_rules.text_stats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: 8, 2: 0, 3: 2}
