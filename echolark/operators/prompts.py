"""Prompts for a speaker, messages in their language, and samples from floats."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echolark.core import read_table

#: The closed vocabulary and the sentences for it, and for other words.
VOCABULARY = ("bird", "follow", "forward", "happy", "learn")
OWN = ("The happy bird will learn to fly forward and follow the flock.", "A happy bird can learn to move forward and follow the flock.")
GENERIC = ("Please read these words clearly: ", "Now say the following words naturally: ")
#: Messages by language.
MESSAGES = {
    "en": {"retry": "Insufficient audio: please try again.", "review": "Recording captured; professional review is required."},
    "it": {"retry": "Audio insufficiente: ripetere.", "review": "Registrazione acquisita; revisione del logopedista richiesta."},
}


def language(locale: Column) -> Column:
    """The language of a locale, English where there is none; null where it is not supported."""
    name = F.lower(F.split_part(F.coalesce(locale, F.lit("en")), F.lit("-"), F.lit(1)))
    return F.when(name.isin(*MESSAGES), name)


def message(locale: Column, key: Column) -> Column:
    """A message in the locale's language; null where language or key are unknown."""
    table = F.create_map(*[F.lit(x) for lang, own in MESSAGES.items() for k, text in own.items() for x in (f"{lang}:{k}", text)])
    return F.try_element_at(table, F.concat_ws(":", language(locale), key))


def drawn(seed: pd.Series) -> pd.Series:
    """The first of two draws of the standard library's generator for a text seed."""
    return seed.map(lambda s: random.Random(s).randrange(2))


def composed(targets: Column, seed: Column | None = None) -> tuple[Column, Column, Column]:
    """(text, support words, template) of a sentence that holds all targets: of the vocabulary's own
    sentences where targets are all of it, else a list. The draw depends on the seed, or else on the words."""
    words = F.array_distinct(F.transform(targets, lambda w: F.lower(F.trim(w))))
    draw = F.pandas_udf(drawn, "int")
    own = F.sha2(F.array_join(words, "\0"), 256)
    k = draw(own if seed is None else F.coalesce(seed, own))
    n = F.size(words)
    listed = F.when(n == 1, words[0]).otherwise(F.concat(F.array_join(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(1))), ", "), F.lit(", and "), F.element_at(words, -1)))
    whole = F.array_sort(words) == F.array(*map(F.lit, VOCABULARY))
    text = F.when(whole, F.element_at(F.array(*map(F.lit, OWN)), k + 1)).otherwise(F.concat(F.element_at(F.array(*map(F.lit, GENERIC)), k + 1), listed, F.lit(".")))
    tokens = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+(?:'[a-z]+)?"), F.lit(0))
    template = F.concat(F.when(whole, "current-vocabulary-").otherwise("controlled-list-"), (k + 1).cast("string"))
    return text, F.array_except(tokens, words), template


def compose_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt for every customer, of the words that its key picks."""
    c = read_table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 32).cast("int").alias("mask"))
    picked = F.filter(F.array(*map(F.lit, VOCABULARY)), lambda w, i: F.call_function("getbit", F.col("mask"), i) == 1)
    c = c.where("mask > 0").withColumn("targets", picked)
    text, support, template = composed(F.col("targets"), F.col("c_custkey").cast("string"))
    return c.select("c_custkey", text.alias("text"), F.array_join(support, " ").alias("support"), template.alias("template"))


def localized_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each customer is told, in its language; customers of unsupported locales are told nothing."""
    c = read_table(spark, sf_dir, "customer")
    locale = F.when(F.col("c_nationkey") % 4 == 0, "it-IT").when(F.col("c_nationkey") % 4 == 1, "EN-us").when(F.col("c_nationkey") % 4 == 2, "fr")
    key = F.when(F.col("c_acctbal") < 0, "retry").otherwise("review")
    return c.select("c_custkey", language(locale).alias("language"), message(locale, key).alias("message"))


def samples_of(values: Column) -> Column:
    """Floats as 16-bit samples: clipped to one, scaled and rounded, halves to even."""
    return F.transform(values, lambda x: F.rint(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double"))) * 32767).cast("int"))


def float_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every recording's values as samples: how many, their sum and the loudest."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", samples_of(F.transform("embedding", lambda x: x * 4)).alias("s"))
    return e.select("vec_id", F.size("s").cast("long").alias("n"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_max(F.transform("s", F.abs)).alias("peak"))


QUERIES = {f.__name__: f for f in (compose_sentence, localized_messages, float_samples)}
ORACLE_SQL = {
    "localized_messages": """WITH c AS (SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN 'it' WHEN 2 THEN NULL ELSE 'en' END AS language, c_acctbal < 0 AS retry FROM customer)
      SELECT c_custkey, language, CASE WHEN language = 'it' AND retry THEN 'Audio insufficiente: ripetere.' WHEN language = 'it' THEN 'Registrazione acquisita; revisione del logopedista richiesta.'
        WHEN language = 'en' AND retry THEN 'Insufficient audio: please try again.' WHEN language = 'en' THEN 'Recording captured; professional review is required.' END AS message FROM c""",
    "float_samples": "WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(round_even(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, CAST(x * 4 AS FLOAT)::DOUBLE)) * 32767, 0) AS INT)) AS s FROM embeddings) SELECT vec_id, len(s) AS n, CAST(list_sum(s) AS BIGINT) AS total, list_max(list_transform(s, lambda x: abs(x))) AS peak FROM s",
}
