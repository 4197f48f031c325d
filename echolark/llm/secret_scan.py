r"""Secret scans by a linear-chain conditional random field over tokens.

Three fixed patterns give base spans (`assign`, `access`, `hex`). The field tags tokens as begin,
inside or outside of a secret from their shape, the two words before and the one after, whether they
are the value of a name that speaks of secrets (`cues`), and features of the whole file, decoded by
Viterbi; its spans (`crf`) that touch no base span are added. It is trained here on the base spans of
a bounded sample, half of the time with the key word before the secret hidden, so that shape and
surroundings must suffice; copies with letters only keep their key word.

Training reads regions: REACH characters and more around every token that is no plain word (marked
words, tokens with a digit, runs of PLAIN letters). A text is decoded whole: Viterbi leaves out only
tokens for which an upper bound shows that every path with a secret there loses to the one without,
so the tags are those of the whole sequence (`Field.tags`).

Defined cases: null counts as empty and has no spans; a pattern's matches are leftmost and do not
overlap, and a match that is too short is dropped with the text it covers; without any base span in
the sample the field adds nothing; repeated rows and rows of null ids are scanned alike; texts of any
length are decoded whole; other columns pass through, those named like a result give way to it; an
empty table gives an empty result. Training, and only that, reads MAX_REGIONS regions of
MAX_REGION_TOKENS tokens of a document at most.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echolark.core import small_batches, spare

SAMPLE_DOCS = 2_000
MAX_REGIONS, MAX_REGION_TOKENS = 40, 120
REACH = 100
PLAIN = 20
KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
KEY_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Words whose neighbours are told apart by the word itself.
MARKED = (*KEY_WORDS, "key", "api", "akia", "bearer", "auth", "private")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Words in names whose values are secrets; names are split at marks and camel case.
NAMES = {*KEY_WORDS, "key", "auth", "bearer", "private", "pwd", "pass", "passphrase", "passcode", "credential", "credentials", "passwords", "secrets", "tokens"}
PARTS = re.compile(r"[^\W\d_][^\W\d_A-Z]+|[^\W\d_]+?(?![^\W\d_])|[A-Z]+(?=[A-Z])")
STEMS = [x for x in NAMES if not any(y in x and y != x for y in NAMES)]
TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
#: A marked word, a token with a digit, or one of PLAIN letters and more; possessive, so linear in the text.
ODD = re.compile(rf"\b(?i:{'|'.join(MARKED)})\b|(?<![^\W_])[^\W\d_]{{0,{PLAIN - 1}}}+[^\W_]++")
O, B, I = 0, 1, 2  # noqa: E741
NEVER = -1e9


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, start of the secret itself) of the fixed patterns."""
    found = []
    low = text.lower()
    if any(k in low for k in KEY_WORDS):
        found += [(m.start(), m.end(), "assign", m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access", m.start()) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex", m.start()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def file_features(text: str) -> list[str]:
    return [f"file:{name}" for name, on in (("assigns", " = " in text or "=\"" in text), ("braces", "{" in text), ("keys", "-----BEGIN" in text), ("long", len(text) > 10_000)) if on] + ["file:any"]


@lru_cache(50_000)
def shape_features(token: str) -> tuple[str, ...]:
    n, digits = len(token), sum(c.isdigit() for c in token)
    letters = [c for c in token if c.isalpha()]
    size = "1" if n == 1 else "2-5" if n < 6 else "6-11" if n < 12 else "12-19" if n < PLAIN else "20-31" if n < 32 else "32+"
    kind = "punct" if not digits and not letters else "digits" if not letters else "letters" if not digits else "mixed"
    case = "lower" if token.islower() else "upper" if token.isupper() else "title" if token.istitle() else "camel" if letters else "none"
    hexa = bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", token)) and n > 5
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:]))
    spread = len(set(token)) / n
    return (f"kind:{kind}", f"size:{kind}:{size}", f"case:{kind}:{case}", f"hex:{hexa}:{kind}:{size}", f"turns:{min(turns, 8) // 2}:{kind}", f"spread:{int(4 * spread)}:{kind}:{size}")


def word_feature(token: str | None) -> str:
    if token is None:
        return "edge"
    if len(token) == 1 and not token.isalnum():
        return token
    return token.lower() if token.lower() in MARKED else shape_features(token)[0]


def speaks_of_secrets(token: str) -> bool:
    low = token.lower()
    return low in NAMES or any(x in low for x in STEMS) and any(x.lower() in NAMES for x in PARTS.findall(token))


def cues(tokens: list[str], named: Iterable[int] | None = None) -> list[int]:
    """Places of values: a name that holds a word of NAMES, other parts of it joined by marks, a sign, the value."""
    found, n = [], len(tokens)
    for i in (k for k, t in enumerate(tokens) if speaks_of_secrets(t)) if named is None else named:
        j = i + 1
        while j + 1 < n and tokens[j] in "_-." and tokens[j + 1].isalnum():
            j += 2
        if j < n and tokens[j] in "\"'":
            j += 1
        signs = j
        while j < n and tokens[j] in ":=":
            j += 1
        if signs < j:
            while j < n and tokens[j] in "\"'`":
                j += 1
            if j < n and tokens[j].isalnum():
                found.append(j)
    return found


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches of text to learn from: around every token that is not a plain word."""
    out: list[list[int]] = []
    for m in ODD.finditer(text):
        a, b = max(0, m.start() - REACH), m.end() + REACH
        while a > 0 and a > m.start() - 2 * REACH and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and b < m.end() + 2 * REACH and not text[b].isspace():
            b += 1
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, min(b, len(text))])
    return [(a, min(b, len(text))) for a, b in out]


def tagged(text: str) -> list[tuple[list[str], list[int]]]:
    """Tokens and base tags of each region, for training."""
    secrets = [(s, e) for _, e, _, s in base_spans(text)]
    out = []
    for a, b in regions(text):
        tokens, tags = [], []
        for m in list(TOKEN.finditer(text, a, b))[:MAX_REGION_TOKENS]:
            held = [s for s, e in secrets if s <= m.start() < e]
            tokens.append(m.group())
            tags.append(O if not held else I if tags and tags[-1] != O and m.start() > min(held) else B)
        out.append((tokens, tags))
    return out


class Field:
    """Weights by feature for the three tags, and the transitions between them."""

    def __init__(self, weights: dict[str, tuple[float, float, float]], transitions: list[list[float]]):
        self.weights, self.transitions = weights, transitions
        self._fresh()

    def _fresh(self) -> None:
        self.ids: dict[str, int] = {}
        self.rows: dict[tuple, int] = {}
        self.parts, self.named = np.zeros((0, 4, 3)), np.zeros(0, bool)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("ids", "rows", "parts", "named")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._fresh()

    def _sum(self, names) -> tuple[float, float, float]:
        rows = [self.weights[n] for n in names if n in self.weights]
        return tuple(map(sum, zip(*rows, strict=True))) if rows else (0.0, 0.0, 0.0)

    def _numbered(self, tokens: list[str]) -> np.ndarray:
        """Rows of `parts` for the tokens: what each adds by its own shape, and as a neighbour."""
        if len(self.ids) > 200_000:
            self._fresh()
        ids, made = self.ids, []
        for token in set(tokens).difference(ids):
            named = speaks_of_secrets(token)
            look = (shape_features(token), word_feature(token), named)
            if (k := self.rows.get(look)) is None:
                k = self.rows[look] = len(self.rows)
                made.append(([self._sum(look[0]), *(self._sum([f"{place}:{look[1]}"]) for place in ("p1", "p2", "n1"))], named))
            ids[token] = k
        if made:
            self.parts = np.concatenate([self.parts, np.array([x for x, _ in made])])
            self.named = np.concatenate([self.named, np.array([x for _, x in made])])
        return np.fromiter(map(ids.__getitem__, tokens), np.int64, len(tokens))

    def emissions(self, tokens: list[str], file: tuple[float, float, float]) -> np.ndarray:
        at = self._numbered(tokens)
        e = self.parts[at, 0] + np.array(file)
        edge = [np.array(self._sum([f"{place}:edge"])) for place in ("p1", "p2", "n1")]
        e[1:] += self.parts[at[:-1], 1]
        e[2:] += self.parts[at[:-2], 2]
        e[:-1] += self.parts[at[1:], 3]
        e[:1] += edge[0]
        e[:2] += edge[1]
        e[-1:] += edge[2]
        e[sorted(set(cues(tokens, np.flatnonzero(self.named[at]).tolist())))] += np.array(self._sum(["cue:yes"]))
        return e

    def viterbi(self, e: list[list[float]], first: bool = True, last: bool = True) -> list[int]:
        """The best tags of a run of tokens; outside ones stand before and after it unless it is first or last."""
        t, back = self.transitions, []
        score = [e[0][O], e[0][B], NEVER] if first else [t[O][y] + e[0][y] for y in (O, B, I)]
        for row in e[1:]:
            best = tuple(max((O, B, I), key=lambda p, y=y: score[p] + t[p][y]) for y in (O, B, I))
            score = [score[best[y]] + t[best[y]][y] + row[y] for y in (O, B, I)]
            back.append(best)
        tags = [max((O, B, I), key=lambda y: score[y] + (0 if last else t[y][O]))]
        for best in reversed(back):
            tags.append(best[tags[-1]])
        return tags[::-1]

    def tags(self, tokens: list[str], file: tuple[float, float, float]) -> dict[int, int]:
        """The tags other than outside of the whole sequence's best path, by place.

        A secret at i..j changes the score of the path without it by starts[i] + sum(goes[i+1..j]) +
        ends[j] at most. Tokens for which no i and j give that 0 or more are outside on the best path
        and part the sequence.
        """
        if not tokens:
            return {}
        e, t = self.emissions(tokens, file), self.transitions
        starts = e[:, B] - e[:, O] + (t[O][B] - t[O][O])
        starts[0] = e[0, B] - e[0, O]
        goes = np.maximum(e[:, B] + max(t[B][B], t[I][B]), e[:, I] + max(t[B][I], t[I][I])) - e[:, O] - t[O][O]
        ends = np.full(len(e), max(t[B][O], t[I][O]) - t[O][O])
        ends[-1] = 0
        sums = np.cumsum(goes)
        most = np.maximum.accumulate(starts - sums) + np.maximum.accumulate((sums + ends)[::-1])[::-1]
        live = np.flatnonzero(most >= -1e-6)
        found = {}
        for run in np.split(live, np.flatnonzero(np.diff(live) > 1) + 1) if len(live) else []:
            a, b = int(run[0]), int(run[-1]) + 1
            best = self.viterbi(e[a:b].tolist(), a == 0, b == len(e))
            found |= {a + k: y for k, y in enumerate(best) if y != O}
        return found

    def spans(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of the secrets of a text."""
        if not self.weights:
            return []
        out, tags = [], self.tags(TOKEN.findall(text), self._sum(file_features(text)))
        for k, m in enumerate(TOKEN.finditer(text)) if tags else ():
            if (tag := tags.get(k, O)) == B:
                out.append([m.start(), m.end()])
            elif tag == I and out:
                out[-1][1] = m.end()
        return [(a, b) for a, b in out]


def token_features(tokens: list[str], file: list[str], cued: Iterable[int] | None = None) -> list[list[str]]:
    padded, cued = [None, None, *tokens, None], set(cues(tokens) if cued is None else cued)
    return [[*shape_features(tokens[k]), f"p1:{word_feature(padded[k + 1])}", f"p2:{word_feature(padded[k])}", f"n1:{word_feature(padded[k + 3])}", *file, *["cue:yes"] * (k in cued)] for k in range(len(tokens))]


def fit_field(sequences: list[tuple[list[str], list[int], list[str]]], steps: int = 80, ridge: float = 1e-5, rate: float = 0.3, seed: int = 3) -> Field:
    """Maximum likelihood by Adam over all sequences at once; forward and backward sums give the gradient."""
    rng = random.Random(seed)
    rows = []
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    # copies of regions with secrets in which those are random strings of another shape
    made = [([t if y == O else "".join(rng.choices(letters, k=rng.randint(12, 44))) for t, y in zip(tokens, tags, strict=True)], tags, file) for tokens, tags, file in sequences if B in tags for _ in range(2)]
    for tokens, tags, file in [*sequences, *made]:
        hidden = ["word" if t.lower() in KEY_WORDS and rng.random() < 0.5 else t for t in tokens]
        rows.append((token_features(hidden, file), tags))
    # values of names may be letters only, behind any sign, and the name's last part any word
    for tokens, tags, file in sequences:
        cued = [k for k in sorted(set(cues(tokens))) if tags[k] == B]
        plain, marks, at = [], [], []
        for k, (token, y) in enumerate(zip(tokens, tags, strict=True)):
            if k in cued:
                while plain and plain[-1] in ":=\"'`":
                    del plain[-1], marks[-1]
                if rng.random() < 0.5:
                    plain[-1] = "word"
                sign = [rng.choice(":="), *rng.choice(["", "", '"', "'"])]
                at.append(len(plain) + len(sign))
                plain += [*sign, "".join(rng.choices(letters[:26], k=rng.randint(6, 19)))]
                marks += [O] * len(sign) + [B]
            elif y != I:
                plain.append(token)
                marks.append(y)
        if cued:
            rows.append((token_features(plain, file, at), marks))
    if not any(B in tags for _, tags in rows):
        return Field({}, [[0.0] * 3 for _ in range(3)])
    names = {n: k for k, n in enumerate(sorted({f for features, _ in rows for t in features for f in t}))}
    count, length, width = len(rows), max(len(t) for _, t in rows), max(len(t) for f, _ in rows for t in f)
    ids = np.full((count, length, width), len(names))
    y, mask = np.zeros((count, length), np.int64), np.zeros((count, length), bool)
    for i, (features, tags) in enumerate(rows):
        mask[i, : len(tags)] = True
        y[i, : len(tags)] = tags
        for k, f in enumerate(features):
            ids[i, k, : len(f)] = [names[n] for n in f]
    w, t = np.zeros((len(names) + 1, 3)), np.zeros((3, 3))
    t[O, I] = NEVER
    one = np.eye(3)[y] * mask[..., None]
    pairs = np.einsum("nta,ntb->ab", one[:, :-1], one[:, 1:] * mask[:, 1:, None])
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
    lse = lambda x, axis: (m := x.max(axis=axis, keepdims=True), np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis)))[1]
    for step in range(1, steps + 1):
        e = w[ids].sum(axis=2)
        alpha, beta = np.full((count, length, 3), NEVER), np.zeros((count, length, 3))
        alpha[:, 0] = e[:, 0] + np.array([0, 0, NEVER])
        for k in range(1, length):
            alpha[:, k] = np.where(mask[:, k, None], lse(alpha[:, k - 1, :, None] + t, 1) + e[:, k], alpha[:, k - 1])
        for k in range(length - 2, -1, -1):
            beta[:, k] = np.where(mask[:, k + 1, None], lse(t + (e[:, k + 1] + beta[:, k + 1])[:, None, :], 2), 0.0)
        z = lse(alpha[:, -1], 1)
        p = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
        two = np.exp(np.clip(alpha[:, :-1, :, None] + t + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None], -60, 0)) * mask[:, 1:, None, None]
        gw, gt = np.zeros_like(w), two.sum(axis=(0, 1)) - pairs
        np.add.at(gw, ids.reshape(-1), np.repeat((p - one).reshape(-1, 3), width, axis=0))
        gw, gt = gw / count + ridge * w, gt / count + ridge * np.where(t > NEVER / 2, t, 0)
        gw[-1], gt[O, I] = 0, 0
        for k, (x, g) in enumerate(((w, gw), (t, gt))):
            moments[2 * k] = 0.9 * moments[2 * k] + 0.1 * g
            moments[2 * k + 1] = 0.99 * moments[2 * k + 1] + 0.01 * g * g
            x -= rate * (moments[2 * k] / (1 - 0.9**step)) / (np.sqrt(moments[2 * k + 1] / (1 - 0.99**step)) + 1e-8)
    return Field({n: tuple(w[k].tolist()) for n, k in names.items()}, t.tolist())


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Field:
    """A field trained on the regions of at most sample_docs documents, in order of a hash of their id."""
    small_batches(docs.sparkSession)
    chosen = docs.select("doc_id").where(F.col("doc_id").isNotNull()).distinct().orderBy(F.xxhash64(F.lit(29), "doc_id")).limit(sample_docs)
    kind = pa.list_(pa.struct([("tokens", pa.list_(pa.string())), ("tags", pa.list_(pa.int32()))]))
    mark = F.arrow_udf(lambda c: pa.array([[{"tokens": a, "tags": b} for a, b in tagged(x.as_py() or "")][:MAX_REGIONS] for x in c], kind), "array<struct<tokens:array<string>,tags:array<int>>>")
    of_file = F.arrow_udf(lambda c: pa.array([file_features(x.as_py() or "") for x in c], pa.list_(pa.string())), "array<string>")
    some = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", mark("text").alias("regions"), of_file("text").alias("file"))  # a filter on regions would be run below the join, on all documents
    rows = sorted(some.collect(), key=lambda r: r.doc_id)
    return fit_field([(list(x.tokens), list(x.tags), list(r.file)) for r in rows for x in r.regions if x.tokens])


def scan(text: str, field: Field) -> list[tuple[int, int, str]]:
    """All spans of a text in order: base spans, and those of the field that touch none of them."""
    base = [(a, b, kind) for a, b, kind, _ in base_spans(text)]
    more = [(a, b, "crf") for a, b in field.spans(text) if all(b <= s or e <= a for s, e, _ in base)]
    return sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2])))


def _written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scanned(docs: DataFrame, field: Field) -> DataFrame:
    """docs with n_assign, n_access, n_hex, base_sha256 and spans."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def find(column: pa.Array) -> pa.Array:
        rows = []
        for x in column:
            spans = scan(x.as_py() or "", shared.value)
            base = [s for s in spans if s[2] != "crf"]
            rows.append((*(sum(s[2] == k for s in base) for k in KINDS[:3]), hashlib.sha256(_written(base).encode()).hexdigest(), _written(spans)))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    found: Column = F.arrow_udf(find, "struct<n_assign:bigint,n_access:bigint,n_hex:bigint,base_sha256:string,spans:string>")(F.col("text"))
    at = spare(docs, "found")
    return docs.withColumn(at, found).withColumns({k: F.col(f"{at}.{k}") for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}).drop(at)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scanned(docs, fit(docs)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
