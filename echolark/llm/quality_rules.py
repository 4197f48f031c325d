"""Learned decision lists over text statistics.

`text_stats` measures every whole text. `learn_rules` fits an ordered list of threshold conjunctions
by sequential covering: a rule is grown condition by condition for the most FOIL gain on two thirds
of the rows, pruned from its end on the other third, kept while it is precise there, and the rows it
covers are taken away before the next. The list is emitted as one Spark conditional expression, so
judging costs no Python beyond the statistics.

Defined cases: a null or empty text has no words and fails the base rule; repeated rows are judged
alike; other columns pass through and columns named like the results are replaced; an empty table
gives an empty result. Without labelled rows of both kinds the list is empty and only the base rule
rejects. Texts of any length are measured whole; ties of gain go to the first statistic and cut.
Training reads at most MAX_TRAINING labelled rows, taken in order of a hash of their id, and gives
max_rules rules of max_conditions conditions at most: 12 of 3 by default, a bound of the model, not of the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echolark.core import small_batches, spare
from echolark.llm.textbytes import SPACE, lines_of, per_doc, run_hashes, span_counts, texts_of, windows, words_of

MAX_TRAINING = 20_000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_chars", "n_upper", "n_digits", "n_bars", "n_marks", "n_common_words"]
RATIOS = {
    "mean_word": ("word_chars", "n_words"), "symbol_ratio": ("n_symbols", "n_words"), "dup_line_ratio": ("n_dup_lines", "n_lines"), "repeat_ratio": ("n_repeat_words", "n_words"),
    "upper_ratio": ("n_upper", "n_chars"), "digit_ratio": ("n_digits", "n_chars"), "bar_ratio": ("n_bars", "n_words"), "mark_ratio": ("n_marks", "n_words"), "top_word_ratio": ("n_common_words", "n_words"), "words_a_line": ("n_words", "n_lines"),
}
WINDOW = 5


def _table(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(characters, np.uint8)] = True
    return out


SYMBOLS, BARS, MARKS = _table(b"#*$%&|<>"), _table(b"|"), _table(b"!?")
UPPER, DIGITS = _table(bytes(range(65, 91))), _table(bytes(range(48, 58)))
#: Bytes that start a code point.
LEADS = np.arange(256) & 0xC0 != 0x80


def _dup_counts(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each run: is an equal one earlier in its document, and how many equal ones there are."""
    order = np.lexsort((np.arange(len(keys)), keys, doc))
    same = np.zeros(len(keys), bool)
    same[1:] = (keys[order][1:] == keys[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    group = np.cumsum(~same) - 1
    earlier, count = np.empty(len(keys), bool), np.empty(len(keys), np.int64)
    earlier[order] = same
    count[order] = np.bincount(group, minlength=1)[group] if len(keys) else 0
    return earlier, count


def counts_of(column: pa.Array) -> np.ndarray:
    """COUNTS of each text of an Arrow column, one row each."""
    parts = [np.zeros((0, len(COUNTS)), np.int64)]
    for t in texts_of(column):
        n, words, lines = len(t), words_of(t), lines_of(t)
        hashes = run_hashes(t.data, words.starts, words.ends)
        at, keys = windows(hashes, words.doc, WINDOW)
        _, times = _dup_counts(keys, words.doc[at])
        twice = at[times > 1]
        edges = np.bincount(twice, minlength=len(words) + WINDOW + 1) - np.bincount(twice + WINDOW, minlength=len(words) + WINDOW + 1)
        covered = np.cumsum(edges)[: len(words)] > 0
        again, _ = _dup_counts(run_hashes(t.data, lines.starts, lines.ends), lines.doc)
        _, uses = _dup_counts(hashes, words.doc)
        most = np.zeros(n, np.int64)
        np.maximum.at(most, words.doc, uses)
        sums = [span_counts(x, t.offsets) for x in (LEADS[t.data], UPPER[t.data], DIGITS[t.data], BARS[t.data], MARKS[t.data])]
        parts.append(np.stack([np.diff(words.first), span_counts(LEADS[t.data] & ~SPACE[t.data], t.offsets), span_counts(SYMBOLS[t.data], t.offsets), per_doc(again, lines.doc, n), per_doc(covered, words.doc, n), np.diff(lines.first), *sums, most], axis=1))
    return np.concatenate(parts)


def _stats(column: pa.Array) -> pa.Array:
    found = counts_of(column)
    return pa.StructArray.from_arrays([pa.array(found[:, k]) for k in range(len(COUNTS))], names=COUNTS)


def statistics(df: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """df with COUNTS as one struct, and the name of that column, which df does not have."""
    small_batches(df.sparkSession)
    stats = F.arrow_udf(_stats, "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">")
    name = spare(df, "stats")
    return df.withColumn(name, stats(F.col(f"`{text}`"))), name


def base_failed(at: str = "") -> Column:
    """Too few words, or too many in windows that repeat."""
    n = F.col(f"{at}n_words")
    return (n < 10) | (F.lit(100) * F.col(f"{at}n_repeat_words") > F.lit(20) * n)


def text_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """df with COUNTS and base_failed."""
    own, name = statistics(df, text)
    return own.withColumns({c: F.col(f"{name}.{c}") for c in COUNTS}).drop(name).withColumn("base_failed", base_failed())


def ratio(name: str, at: str = "") -> Column:
    top, bottom = RATIOS[name]
    return F.when(F.col(at + bottom) > 0, F.col(at + top) / F.col(at + bottom)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        v = x[:, names.index(self.name)]
        return v >= self.threshold if self.above else v <= self.threshold

    def column(self, at: str = "") -> Column:
        v = ratio(self.name, at)
        return v >= F.lit(self.threshold) if self.above else v <= F.lit(self.threshold)


Rule = tuple[Condition, ...]


def _grown(x: np.ndarray, y: np.ndarray, names: list[str], max_conditions: int, cuts: int) -> Rule:
    """Conditions added one by one, each the one with the most FOIL gain."""
    inside, rule = np.ones(len(y), bool), []
    while len(rule) < max_conditions and (~y[inside]).any():
        p0, n0 = y[inside].sum(), (~y[inside]).sum()
        best, best_gain = None, 1e-9
        for k, name in enumerate(names):
            for threshold in np.unique(np.quantile(x[inside, k], np.linspace(0.02, 0.98, cuts))):
                for above in (True, False):
                    c = Condition(name, above, float(threshold))
                    hit = inside & c.holds(x, names)
                    p, n = y[hit].sum(), (~y[hit]).sum()
                    if p and (gain := p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))) > best_gain:
                        best, best_gain = c, gain
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x, names)
    return tuple(rule)


def _covered(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x, names)
    return out


def _pruned(rule: Rule, x: np.ndarray, y: np.ndarray, names: list[str]) -> tuple[Rule, float, int]:
    """The prefix of the rule with the best (p - n) / (p + n) on held-back rows; its precision and cover."""
    best = (-2.0, rule, 0.0, 0)
    for size in range(len(rule), 0, -1):
        hit = _covered(rule[:size], x, names)
        p, n = int(y[hit].sum()), int((~y[hit]).sum())
        worth = (p - n) / (p + n) if p + n else -2.0
        if worth > best[0]:
            best = (worth, rule[:size], p / (p + n), p + n)
    return best[1:]


def learn_rules(x: np.ndarray, bad: np.ndarray, names: list[str], max_rules: int = 12, max_conditions: int = 3, min_precision: float = 0.8, min_cover: int = 3, cuts: int = 25, seed: int = 11) -> list[Rule]:
    """An ordered list of rules that single out `bad` rows; rows that none covers are good."""
    rules: list[Rule] = []
    fold = np.random.default_rng(seed).permutation(len(bad)) % 3
    left = np.ones(len(bad), bool)
    while len(rules) < max_rules:
        grow, prune = left & (fold > 0), left & (fold == 0)
        if not bad[grow].any() or bad[grow].all():
            break
        rule = _grown(x[grow], bad[grow], names, max_conditions, cuts)
        if not rule:
            break
        rule, precision, cover = _pruned(rule, x[prune], bad[prune], names)
        whole = _covered(rule, x[left], names)
        if precision < min_precision or cover < min_cover or bad[left][whole].mean() < min_precision:
            break
        rules.append(simplified(rule))
        left &= ~_covered(rule, x, names)
    return rules


def simplified(rule: Rule) -> Rule:
    """The rule without conditions that a tighter one of the same statistic and side implies."""
    tightest: dict[tuple[str, bool], Condition] = {}
    for c in rule:
        old = tightest.get((c.name, c.above))
        if old is None or (c.threshold > old.threshold) == c.above:
            tightest[c.name, c.above] = c
    return tuple(c for c in rule if tightest[c.name, c.above] == c)


def as_condition(rules: list[Rule], at: str = "") -> Column:
    """The ordered list as one conditional expression: true where a rule rejects."""
    chain = None
    for rule in rules:
        test = rule[0].column(at)
        for c in rule[1:]:
            test = test & c.column(at)
        chain = F.when(test, F.lit(True)) if chain is None else chain.when(test, F.lit(True))
    return F.lit(False) if chain is None else chain.otherwise(F.lit(False))


def fit_rules(docs: DataFrame, labels: DataFrame, max_training: int = MAX_TRAINING) -> list[Rule]:
    """A list learned from labels.quality (0: bad) of at most max_training labelled rows that pass the base rule."""
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "quality")
    chosen = chosen.orderBy(F.xxhash64(F.lit(5), "doc_id"), "quality").limit(max_training)
    known = text_stats(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")).where(~F.col("base_failed"))
    names = list(RATIOS)
    rows = known.select("quality", *[ratio(k).alias(k) for k in names]).toPandas()
    return learn_rules(rows[names].to_numpy(float), (rows["quality"] == 0).to_numpy(), names)


def judged(docs: DataFrame, labels: DataFrame, training: DataFrame | None = None) -> DataFrame:
    """docs with their statistics, base_failed and kept; rules come from `training`, by default docs themselves."""
    rules = fit_rules(docs if training is None else training, labels)
    return text_stats(docs).withColumn("kept", ~F.col("base_failed") & ~as_condition(rules))


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs that the base rule and the learned list keep, with all their own columns and no others."""
    rules = fit_rules(docs, labels)
    own, name = statistics(docs)
    return own.where(~base_failed(f"{name}.") & ~as_condition(rules, f"{name}.")).drop(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every whole text of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = judged(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
