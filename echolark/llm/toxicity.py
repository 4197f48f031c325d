"""Toxicity scores from a learned lexicon, matched with misspellings, weighed by learned context.

The lexicon holds terms that labelled toxic texts use far more often than others and in many
different surroundings, so that copies of one text add nothing, and stems that the same holds for, which
catch inflected forms. Terms may be contested: used in other texts too, as quotations are, but
significantly and clearly less. Words that resemble terms but are used less by toxic texts than the term's own share
allows are exceptions. The terms' trie is intersected with the
Levenshtein automaton of each distinct token: a state is a row of edit distances, branches whose row
exceeds the bound are dropped, and a bound on differing letters spares most tokens the walk.

Each hit has a window: the words within CONTEXT places on either side and the marks next to it. Of each such cue, labelled hits give smoothed log odds of abuse; their sum over a
hit's window separates quotation from abuse, with no list of cue words. A logistic model over a text's hits
gives the score. Lexicon, cues and weights are learned crosswise: three fifths of the labelled rows give the
lexicon, each of the other two gives the cues by which the rows of its counterpart are weighed.

Learning uses labelled rows outside the held-out third only (crc32 of the id modulo 3 is 1), at most
MAX_TRAINING of them in order of a hash of their id; all terms, cues and exceptions that these rows give are
kept. Label, language, source and id are no inputs.

Defined cases: null, empty and word-free texts have no hits and get the score of such texts; without
labels of both kinds the lexicon is empty and every score is the prior; rows that repeat are scored alike;
texts and words of any length are read whole; other columns pass through and columns named like the results
are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echolark.core import scratch, small_batches, staged

MAX_TRAINING = 20_000
STEM_SIZES = (5, 6, 7, 8)
MIN_FORMS = 5
TOKEN = re.compile(r"\w[\w@$*]*")
TOKEN_SQL = r"[^\p{L}\p{N}_@$*]+"
THRESHOLD = 0.7
CONTEXT = 6
MIN_PRECISION = 0.8
#: Standard errors between the shares of a contested term in toxic and in other surroundings, and their least quotient.
CONTESTED_Z, CONTESTED_RATIO = 5.0, 1.5
#: Labelled hits that a cue needs, the hits its odds are smoothed by, and the bound of a window's sum.
MIN_CUE_HITS, CUE_PRIOR, MOST_CONTEXT = 3, 8.0, 6.0
MEMO_ENTRIES = 200_000
#: Characters that stand for letters.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})
FEATURES = ["any", "misspelled", "strength", "abuse", "mention", "rate", "distinct"]
#: The cue that every hit has, whose counts are those of all hits.
ANY_HIT = "hit"


class Lexicon:
    """A trie of terms: each node maps letters to nodes, None to the term that ends there. Stems match
    the start of a token letter by letter; exceptions match nothing. `odds` has the log odds of terms and stems."""

    def __init__(self, terms: list[str], stems: list[str] = (), exceptions: frozenset[str] = frozenset(), odds: dict[str, float] | None = None):
        self.odds = odds or {}
        self.terms, self.stems, self.exceptions = sorted(terms), sorted(stems), exceptions
        self.stem_set, self.stem_sizes = frozenset(stems), sorted({len(x) for x in stems})
        self.trie: dict = {}
        for term in self.terms:
            node = self.trie
            for letter in term:
                node = node.setdefault(letter, {})
            node[None] = term
        #: Letters, bound, letter pairs and pairs needed of the terms that a token of each length may reach.
        self.shapes: dict[int, list[tuple[frozenset, int, frozenset, int]]] = {}
        for term in self.terms:
            b = self.bound(len(term))
            for length in range(len(term) - b, len(term) + b + 1):
                pairs = frozenset(map("".join, zip(term, term[1:])))
                self.shapes.setdefault(length, []).append((frozenset(term), b, pairs, len(pairs) - 2 * b))

    @staticmethod
    def bound(length: int) -> int:
        """Edits allowed for a term of this length."""
        return 0 if length < 4 else 1 if length < 10 else 2

    def walk(self, token: str) -> tuple[str, int] | None:
        """The nearest term within its bound: the token's automaton run down the trie."""
        best: tuple[int, str] | None = None
        n, most = len(token), max((x[1] for x in self.shapes.get(len(token), ())), default=0)
        far = most + 1
        stack = [(self.trie, 0, [min(k, far) for k in range(n + 1)])]
        while stack:
            node, depth, row = stack.pop()
            if (term := node.get(None)) is not None and row[n] <= self.bound(len(term)) and (best is None or (row[n], term) < best):
                best = (row[n], term)
            low, high = max(0, depth - most), min(n, depth + 1 + most)
            for letter, child in node.items():
                if letter is None:
                    continue
                after = [far] * (n + 1)
                if depth + 1 < far:
                    after[0] = depth + 1
                least = after[0]
                for k in range(low, high):
                    d = row[k] + (token[k] != letter)
                    if after[k] < d:
                        d = after[k] + 1 if after[k] + 1 < d else d
                    if row[k + 1] + 1 < d:
                        d = row[k + 1] + 1
                    after[k + 1] = d if d < far else far
                    if d < least:
                        least = d
                if least <= most:
                    stack.append((child, depth + 1, after))
        return None if best is None else (best[1], best[0])

    def match(self, token: str) -> tuple[str, int] | None:
        """Nearest term of a lower-case token, read as it is and with stand-in characters replaced."""
        if token in self.exceptions:
            return None
        for size in self.stem_sizes:
            if token[:size] in self.stem_set:
                return token[:size], 0
        forms = (token,) if token.isalpha() else {token.rstrip("*$@"), token.translate(LEET).rstrip("*")}
        found = None
        for form in forms:
            if shapes := self.shapes.get(len(form)):
                letters = set(form)
                # an edit changes two letters of the set and two letter pairs of the term at most
                near = [x for x in shapes if len(letters ^ x[0]) <= 2 * x[1]]
                if near:
                    pairs = set(map("".join, zip(form, form[1:])))
                    if any(len(pairs & x[2]) >= x[3] for x in near) and (hit := self.walk(form)) and (found is None or hit[1] < found[1]):
                        found = hit
        return found


class Scorer:
    """A lexicon, log odds of cues by name, weights of FEATURES and a bias."""

    def __init__(self, lexicon: Lexicon, weights: list[float], bias: float, cues: dict[str, float] | None = None):
        self.lexicon, self.weights, self.bias, self.cues = lexicon, weights, bias, cues or {}
        self._fresh()

    def _fresh(self) -> None:
        self.seen: set[str] = set()
        self.matched: dict[str, tuple[str, int]] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("seen", "matched")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._fresh()

    def hits(self, low: str) -> list[tuple[int, str, int]]:
        """(token index, term, edits) of a lower-case text."""
        tokens = TOKEN.findall(low)
        distinct = set(tokens)
        if len(self.seen) > MEMO_ENTRIES:
            self._fresh()
        new = distinct - self.seen
        for token in new:
            if (hit := self.lexicon.match(token)) is not None:
                self.matched[token] = hit
        self.seen |= new
        if self.matched.keys().isdisjoint(distinct):
            return []
        return [(k, *hit) for k, t in enumerate(tokens) if (hit := self.matched.get(t)) is not None]

    def windows(self, low: str) -> Iterator[tuple[str, int, list[str]]]:
        """(term, edits, cues) of the hits of a lower-case text: words before and after, and the marks
        next to the hit on either side and both together."""
        if not (hits := self.hits(low)):
            return
        places = list(TOKEN.finditer(low))
        for k, term, edits in hits:
            start = places[k - 1].end() if k else 0
            end = places[k + 1].start() if k + 1 < len(places) else len(low)
            left, right = low[start : places[k].start()].strip()[-1:], low[places[k].end() : end].strip()[:1]
            cues = {ANY_HIT, f"marks {left} {right}", f"mark before {left}", f"mark after {right}"}
            cues |= {f"before {p.group()}" for p in places[max(0, k - CONTEXT) : k]}
            cues |= {f"after {p.group()}" for p in places[k + 1 : k + 1 + CONTEXT]}
            yield term, edits, sorted(cues)

    def window_cues(self, text: str) -> list[list[str]]:
        return [cues for _, _, cues in self.windows(text.lower())]

    def features(self, text: str, cues: dict[str, float] | None = None) -> list[float]:
        """FEATURES of a text, by its hit in the most abusive window."""
        low, cues = text.lower(), self.cues if cues is None else cues
        found = [(term, edits, sum(cues.get(c, 0.0) for c in window)) for term, edits, window in self.windows(low)]
        if not found:
            return [0.0] * len(FEATURES)
        context = min(max(max(x[2] for x in found), -MOST_CONTEXT), MOST_CONTEXT)
        words = len(TOKEN.findall(low))
        return [
            1.0,
            float(all(edits for _, edits, _ in found)),
            max(self.lexicon.odds.get(term, 0.0) for term, _, _ in found),
            max(0.0, context),
            max(0.0, -context),
            float(np.log1p(100 * len(found) / words)),
            float(np.log1p(len({term for term, _, _ in found}))),
        ]

    def score(self, text: str) -> float:
        z = self.bias + sum(w * x for w, x in zip(self.weights, self.features(text), strict=True))
        return float(1 / (1 + np.exp(-z)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> tuple[list[float], float]:
    """Ridge logistic regression by Newton steps."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    keep = np.full(a.shape[1], ridge)
    keep[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        change = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(keep), a.T @ (p - y) + keep * w)
        w -= change
        if np.abs(change).max() < 1e-9:
            break
    return w[:-1].tolist(), float(w[-1])


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def log_odds(p: float, n: float, n_toxic: int, n_other: int) -> float:
    """Smoothed log odds of a word by the toxic and other texts that use it."""
    return float(np.log((p + 0.5) / (n_toxic + 1)) - np.log((n + 0.5) / (n_other + 1)))


def contested(p: int, n: int, of_toxic: int, of_other: int) -> bool:
    """Whether toxic texts use a word in clearly more of their surroundings than others, so that copies add nothing."""
    both = (p + n) / (of_toxic + of_other)
    gap, spread = p / of_toxic - n / of_other, both * (1 - both) * (1 / of_toxic + 1 / of_other)
    return p * of_other >= CONTESTED_RATIO * n * of_toxic and gap >= CONTESTED_Z * spread**0.5


def at_most(p: int, of: int, share: float) -> float:
    """Chance of p or fewer toxic texts of so many, where each is toxic by `share`."""
    return sum(exp(lgamma(of + 1) - lgamma(k + 1) - lgamma(of - k + 1) + k * log(share) + (of - k) * log1p(-share)) for k in range(p + 1))


def learn_lexicon(train: DataFrame) -> Lexicon:
    """Terms, stems and exceptions of train (doc_id, text, toxic), a bounded sample."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), TOKEN_SQL), lambda w: F.length(w) > 0)
    texts = train.select("doc_id", "toxic", words.alias("words"))
    n_toxic, n_other = texts.agg(F.count(F.when(F.col("toxic") == 1, 1)), F.count(F.when(F.col("toxic") == 0, 1))).first()
    if not n_toxic or not n_other:
        return Lexicon([])
    p, n = F.count(F.when(F.col("toxic") == 1, 1)), F.count(F.when(F.col("toxic") == 0, 1))
    precise = F.col("p") >= MIN_PRECISION * (F.col("p") + F.col("n"))
    ahead = F.col("p") * n_other >= CONTESTED_RATIO * F.col("n") * n_toxic
    often = lambda share: max(3, share * n_toxic)
    spots = staged(texts.select("doc_id", "toxic", F.explode(F.array_distinct("words")).alias("w")))
    used = staged(spots.groupBy("w").agg(p.alias("p"), n.alias("n")))
    top = {r.w: r for r in used.where((F.col("p") >= often(0.03)) & (precise | ahead) & (F.length("w") > 2)).collect()}
    # a term's surroundings: distinct pairs of neighbours in toxic and in other texts
    placed = texts.select("toxic", "words", F.posexplode("words").alias("k", "w"))
    around = placed.select("toxic", "w", F.xxhash64(F.when(F.col("k") > 0, F.get("words", F.col("k") - 1)), F.get("words", F.col("k") + 1)).alias("c"))
    in_all = {r.toxic: r.m for r in around.groupBy("toxic").agg(F.approx_count_distinct(F.xxhash64("w", "c"), 0.02).alias("m")).collect()}
    near = around.where(F.col("w").isin(list(top))).distinct().groupBy("w").agg(p.alias("p"), n.alias("n")).collect()
    counts = {}
    for r in near:
        c = top[r.w]
        if r.p >= often(0.05) and (c.p >= MIN_PRECISION * (c.p + c.n) or contested(r.p, r.n, in_all[1], in_all[0])):
            counts[r.w] = c.p, c.n
    # stems are counted without the words that other texts use as much
    odd = spots.join(used.where((F.col("n") < 2) | precise).select("w"), "w").where(F.length("w") > STEM_SIZES[0])
    grown = odd.select("doc_id", "toxic", "w", F.explode(F.array(*[F.when(F.length("w") > k, F.substring("w", 1, k)) for k in STEM_SIZES])).alias("stem")).where("stem is not null")
    by_stem = grown.groupBy("stem").agg(F.countDistinct(F.when(F.col("toxic") == 1, F.col("doc_id"))).alias("p"), F.countDistinct(F.when(F.col("toxic") == 0, F.col("doc_id"))).alias("n"), F.countDistinct("w").alias("forms"))
    stems: dict[str, tuple[int, int]] = {}
    for r in by_stem.where((F.col("p") >= often(0.03)) & precise & (F.col("forms") >= MIN_FORMS)).orderBy(F.length("stem"), "stem").collect():
        if not any(r.stem[:k] in stems for k in STEM_SIZES):
            stems[r.stem] = r.p, r.n
    odds = {w: log_odds(*c, n_toxic, n_other) for w, c in (stems | counts).items()}
    lexicon = Lexicon(list(counts), list(stems), odds=odds)
    shares = {w: (a + 0.5) / (a + b + 1) for w, (a, b) in (stems | counts).items()}

    def unlike(word: str, toxic: int, other: int) -> bool:
        """Whether a word that matches is used less by toxic texts than what it matches would be."""
        if word in counts or (hit := lexicon.match(word)) is None:
            return False
        share = shares[hit[0]]
        return at_most(toxic, toxic + other, share) <= (1 - MIN_PRECISION if share >= MIN_PRECISION else 0.02)

    judged = F.arrow_udf(lambda w, a, b: pa.array([unlike(*x) for x in zip(w.to_pylist(), a.to_pylist(), b.to_pylist(), strict=True)], pa.bool_()), "boolean")
    plain = used.where("n > 0").where(~precise).where(judged("w", "p", "n")).select("w").collect()
    return Lexicon(lexicon.terms, lexicon.stems, frozenset(r.w for r in plain), odds)


def learn_cues(train: DataFrame, scorer: Scorer, fold: Column) -> dict[int | None, dict[str, float]]:
    """Log odds of the cues around hits, from each fold of train and (None) from all. Windows that
    repeat within a fold and a label count once."""
    windows = _applied(scorer.window_cues, "array<array<string>>", pa.list_(pa.list_(pa.string())), F.col("text"))
    spots = train.select(fold.alias("fold"), "toxic", F.explode(windows).alias("window")).distinct()
    counted = spots.select("fold", "toxic", F.explode("window").alias("cue")).groupBy("cue", "fold").agg(F.sum("toxic").alias("p"), F.count("*").alias("m"))
    rows = [(r.cue, r.fold, r.p, r.m) for r in counted.collect()]
    cues = {}
    for part in (*sorted({r[1] for r in rows}), None):
        sums: dict[str, list[int]] = {}
        for cue, at, p, m in rows:
            if part is None or at == part:
                both = sums.setdefault(cue, [0, 0])
                both[0], both[1] = both[0] + p, both[1] + m
        p, m = sums.pop(ANY_HIT, (0, 0))
        share = (p + 1) / (m + 2)
        prior = np.log(share / (1 - share))
        cues[part] = {c: float(np.log((p + CUE_PRIOR * share) / (m - p + CUE_PRIOR * (1 - share))) - prior) for c, (p, m) in sorted(sums.items()) if m >= MIN_CUE_HITS}
    return cues


def fit(docs: DataFrame, labels: DataFrame, max_training: int = MAX_TRAINING) -> Scorer:
    """A scorer from documents and labels.toxic, outside the held-out third: the lexicon from three
    fifths of the rows, cues and weights from the others, which the exceptions were not drawn from. Each
    of these two is weighed by the cues of the other; the scorer has the cues of both."""
    small_batches(docs.sparkSession)
    with scratch(docs.sparkSession):
        chosen = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "toxic")
        chosen = chosen.orderBy(F.xxhash64(F.lit(13), "doc_id"), "toxic").limit(max_training)
        train = staged(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").repartition(16, "doc_id"))
        part = F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(5))
        scorer = Scorer(learn_lexicon(train.where(part < 3)), [0.0] * len(FEATURES), 0.0)
        cues = learn_cues(train.where(part >= 3), scorer, part)
        across = {3: cues.get(4, {}), 4: cues.get(3, {})}
        vector = F.arrow_udf(lambda text, at: pa.array([scorer.features(x or "", across[k]) for x, k in zip(text.to_pylist(), at.to_pylist(), strict=True)], pa.list_(pa.float64())), "array<double>")
        rows = train.where(part >= 3).select("doc_id", "toxic", vector("text", part).alias("x")).collect()
    if not rows:
        return scorer
    rows.sort(key=lambda r: (r.doc_id, r.toxic, r.x))
    scorer.weights, scorer.bias = fit_logistic(np.array([r.x for r in rows]), np.array([float(r.toxic) for r in rows]))
    scorer.cues = cues[None]
    return scorer


def _applied(f, kind: str, arrow: pa.DataType, text: Column) -> Column:
    def run(column: pa.Array) -> pa.Array:
        return pa.array([f(x.as_py() or "") for x in column], arrow)

    return F.arrow_udf(run, kind)(text)


def scored(docs: DataFrame, scorer: Scorer, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    score = _applied(lambda text: shared.value.score(text), "double", pa.float64(), F.col("text"))
    return docs.withColumn("score", score).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scorer = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, scorer).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
