import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from echolark.operators import prompts


@pytest.mark.parametrize("words, seed", [(["Bird"], "1"), (["learn", " bird", "bird"], "2"), (["one", "two", "three"], None), (list(prompts.VOCABULARY), "7"), (list(prompts.VOCABULARY), "8")])
def test_prompts_hold_their_words(spark, words, seed):
    df = spark.createDataFrame([(words, seed)], "w array<string>, s string")
    text, support, template = df.select(*prompts.composed(F.col("w"), F.col("s"))).first()
    clean = list(dict.fromkeys(w.strip().lower() for w in words))
    k = random.Random(seed if seed is not None else sha256("\0".join(clean).encode()).hexdigest()).randrange(2)
    if set(clean) == set(prompts.VOCABULARY):
        assert (text, template) == (prompts.OWN[k], f"current-vocabulary-{k + 1}")
    else:
        listed = clean[0] if len(clean) == 1 else ", ".join(clean[:-1]) + f", and {clean[-1]}"
        assert (text, template) == (f"{prompts.GENERIC[k]}{listed}.", f"controlled-list-{k + 1}")
    assert not set(support) & set(clean) and len(set(support)) == len(support)


def test_unsupported_languages_have_no_message(spark):
    df = spark.createDataFrame([("it-IT", "retry"), (None, "retry"), ("fr", "retry"), ("en", "other")], "l string, k string")
    assert [r[0] for r in df.select(prompts.message(F.col("l"), F.col("k"))).collect()] == [prompts.MESSAGES["it"]["retry"], prompts.MESSAGES["en"]["retry"], None, None]
