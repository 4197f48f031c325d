"""Toxicity's learned context: quoted and direct uses of the same terms, with opposite labels."""

import random
import re

import pytest

from echolark.llm import toxicity

TERMS = ["worthless", "scumbag", "pathetic", "disgusting"]
DIRECT = ["tu es un {}", "vas te faire voir {}", "quel {} tu fais"]
QUOTED = ["le mot « {} » fut cité", "il lut : « {} » puis partit", "la définition de « {} » est ancienne"]


def misspelt(rng, term):
    k = rng.randrange(1, len(term) - 1)
    return term[:k] + rng.choice("xyz") + term[k + 1 :]


def planted(n):
    """(id, text, toxic, misspelt): a third direct uses, a third quoted ones, a third without a term."""
    rng = random.Random(8)
    cues = re.findall(r"\w+", " ".join(DIRECT + QUOTED))
    word = lambda: rng.choice(cues) if rng.random() < 0.1 else "".join(rng.choices("bdfghkln", k=6))
    rows = []
    for k in range(n):
        kind, wrong = k % 3, rng.random() < 0.3
        term = rng.choice(TERMS)
        use = rng.choice((DIRECT, QUOTED)[kind]).format(misspelt(rng, term) if wrong else term) if kind < 2 else ""
        rows.append((k, " ".join([*(word() for _ in range(15)), use, *(word() for _ in range(15))]), int(kind == 0), wrong and kind < 2))
    return rows


@pytest.fixture(scope="module")
def learned(spark):
    rows = planted(6000)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    scorer = toxicity.fit(docs, labels)
    found = toxicity.scored(docs.where(toxicity.held_out(docs.doc_id)), scorer).collect()
    return rows, scorer, {r.doc_id: (r.score, r.predicted) for r in found}


def test_quotation_is_told_from_abuse_on_held_out_rows(learned):
    rows, scorer, found = learned
    assert set(TERMS) <= set(scorer.lexicon.terms)
    for wrong in (False, True):
        for toxic, kind in ((1, 0), (0, 1), (0, 2)):
            of = [found[k][1] == toxic for k, _, y, w in rows if k in found and k % 3 == kind and (w == wrong or kind == 2)]
            assert len(of) > 50 and sum(of) >= 0.95 * len(of), (wrong, kind, sum(of), len(of))


@pytest.mark.xfail(reason="open: where every use has a context, abuse alone separates, and mention's weight comes out above 0")
def test_weights_have_the_right_signs(learned):
    weights = dict(zip(toxicity.FEATURES, learned[1].weights, strict=True))
    assert weights["abuse"] > 0 > weights["mention"]


def test_cues_are_learned(learned):
    scorer = learned[1]
    # words and marks are learned, none is given
    assert scorer.cues["before mot"] < -1 < 1 < scorer.cues["before tu"] and scorer.cues["marks « »"] < -1
    assert scorer.score("tu es un pathxtic") > 0.7 > 0.3 > scorer.score("le mot « pathxtic » fut cité")


def test_windows_by_plain_search(learned):
    scorer = learned[1]
    text = "Un, deux « scumbag » : trois scumbag"
    words = re.findall(r"\w+", text.lower())
    seen = list(scorer.windows(text.lower()))
    assert [(t, e) for t, e, _ in seen] == [("scumbag", 0)] * 2
    for (_, _, cues), k in zip(seen, [i for i, w in enumerate(words) if w == "scumbag"], strict=True):
        assert {c[7:] for c in cues if c.startswith("before ")} == set(words[max(0, k - toxicity.CONTEXT) : k])
        assert {c[6:] for c in cues if c.startswith("after ")} == set(words[k + 1 : k + 1 + toxicity.CONTEXT])
    assert "marks « »" in seen[0][2] and "mark before " in seen[1][2] and "mark after " in seen[1][2]


def test_one_long_text_and_long_words(learned):
    scorer = learned[1]
    filler = "bdfghk " * 200_000
    assert 0 <= scorer.score("x" * 100_000) <= 1
    assert scorer.hits((filler + "scumbag " + filler).lower()) == [(200_000, "scumbag", 0)]


@pytest.mark.parametrize("labels", [[], [(1, 0), (2, 0)], [(1, 1), (2, 1)], [(1, None), (None, 1)]])
def test_labels_that_teach_nothing(spark, labels):
    docs = spark.createDataFrame([(1, "tu es un scumbag"), (2, None), (3, "")], "doc_id long, text string")
    scorer = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    rows = toxicity.scored(docs, scorer).collect()
    assert len(rows) == 3 and not scorer.lexicon.terms and len({r.score for r in rows}) == 1


def test_chance_of_few_toxic_uses():
    assert toxicity.at_most(0, 1, 0.8) == pytest.approx(0.2) and toxicity.at_most(3, 3, 0.4) == pytest.approx(1.0)
