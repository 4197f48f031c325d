"""Near-duplicate classes against all pairs, where lists hold several components and leaders are unlike their lists."""

import random
import re

import pytest

from echolark.llm import near_dedup


def families(seed):
    """Texts near the threshold: chains of edits from a base, bases that share passages, and copies that each lack one part."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    shared = [word() for _ in range(60)]
    texts = []
    for _ in range(5):
        own = [word() for _ in range(rng.choice([8, 14, 25]))]
        base = shared + own
        step = list(base)
        for k in range(9):
            texts.append(" ".join(step))
            step = list(step if k % 3 else base)
            for _ in range(rng.randint(1, 3)):
                step[rng.randrange(len(step))] = word()
    for k in range(10):  # the shared passage without a part, which all others have
        texts.append(" ".join(shared[:k] + shared[k + rng.randint(1, 4) :]))
    texts += [texts[0], texts[7].upper(), "", None, "one two"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def components(rows, width, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    least = list(range(len(rows)))

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    links = 0
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                links += 1
                a, b = sorted((root(i), root(j)))
                least[b] = a
    return {rows[i][0]: (len(sets[i]), rows[root(i)][0]) for i in range(len(rows))}, links


@pytest.mark.parametrize("seed, width, percent", [(1, 3, 85), (2, 5, 80), (3, 3, 85)])
def test_classes_are_those_of_all_pairs(spark, seed, width, percent):
    rows = families(seed)
    want, links = components(rows, width, percent)
    assert links > 30 and len({c for _, c in want.values()}) > 8
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = near_dedup.near_classes(near_dedup.with_signatures(docs, width), width=width, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
