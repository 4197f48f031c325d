"""Cases in which an operator once did less than its whole job."""

import hashlib
import random
import re

import pytest

from echolark.llm import near_dedup, pii_surrogates, secret_scan


@pytest.fixture(scope="module")
def field():
    named = ["pageTitle = word; lineColor: other", 'kind: "plain" and FULL_NAME = \'words\'', "maxSize = 12 shape=round", "he said: words, DATE_VALUE = today"]
    many = [f'prose here token = "{hashlib.sha1(str(k).encode()).hexdigest()}" more words 1234 of it {k} {named[k % 4]}' for k in range(80)]
    return secret_scan.fit_field([(a, b, secret_scan.file_features(t)) for t in many for a, b in secret_scan.tagged(t)])


@pytest.mark.parametrize("line", ['SECRET_KEY = "correcthorsebatt"', 'db_password_value = "correcthorse"', "client_secret_value: correcthorse", "credentials: correcthorse", "pwd=correcthorse", "userPwd = 'correcthorse'"])
def test_secrets_of_letters_behind_longer_names(field, line):
    text = f"some prose before it\n{line}\nand more of it behind"
    assert [text[a:b].strip("'\"") for a, b, _ in secret_scan.scan(text, field)] == ["correcthorsebatt" if "batt" in line else "correcthorse"]


def test_pruned_decoding_is_that_of_the_whole_text(field):
    rng = random.Random(5)
    pieces = ["word", "other", "_", "=", ":", '"', "secret", "SECRET_KEY", "ab12cd34ef56", "a" * 30, "Zk38dKw03LLqpz77skdWq1", "12", ".", "\n", "pwd", "élan"]
    secrets = 0
    for _ in range(300):
        tokens = secret_scan.TOKEN.findall(" ".join(rng.choices(pieces, k=rng.randint(1, 80))))
        file = field._sum(["file:any"])
        whole = field.viterbi(field.emissions(tokens, file).tolist()) if tokens else []
        found = field.tags(tokens, file)
        secrets += len(found)
        assert [found.get(k, secret_scan.O) for k in range(len(tokens))] == whole
    assert secrets


def test_prose_has_no_secrets(field):
    text = "the secret of life is a token of love, she said: hello. The key thing = nothing; a private matter"
    assert secret_scan.scan(text, field) == []


def test_a_phone_has_one_surrogate_in_all_spellings(spark):
    spellings = ["+49 15112345678", "+4915112345678", "+49-1511-234-5678", "+4 915112345678", "+49 (151) 1234 5678"]
    rows = spark.createDataFrame(list(enumerate(spellings)), "doc_id long, text string")
    out = [r.text for r in pii_surrogates.with_surrogates(rows, "k").orderBy("doc_id").collect()]
    digits = {re.sub(r"\D", "", x) for x in out}
    assert len(digits) == 1 and digits.pop().startswith("49") and not set(out) & set(spellings)
    assert [re.sub(r"\d", "0", x) for x in out] == [re.sub(r"\d", "0", x) for x in spellings]


def test_short_names_never_run_out(spark):
    names = [f"Mr {a}{b}" for a in "ABCDEFGHIJKLMNOPQRST" for b in "abcdefghijklmnopqrst"]
    rows = spark.createDataFrame(list(enumerate(names)), "doc_id long, text string")
    out = [r.text for r in pii_surrogates.with_surrogates(rows, "k").collect()]
    assert len(set(out)) == len(names) and not set(out) & set(names) and all(re.fullmatch(r"Mr [A-Z][a-z]+", x) for x in out)


def test_matches_follow_the_threshold():
    assert [near_dedup.matches(p) for p in (85, 80, 100, 1)] == [27, 24, 48, 1]
