"""Toxicity by a counterfactually regularised linear classifier.

Features are a text's distinct lower-case words and their beginnings.  A
logistic model with an L1 penalty is fitted on the driver to a bounded sample of
labelled rows.  For each identity term in a labelled sentence the sentence is
also taken with the term swapped for others of its kind; a penalty on the
squared difference of the two sentences' scores keeps the model from learning
that merely naming a group is toxic.  Scoring is one pass over the whole texts with the few features
that have weight.

Bounds, all parameters: ``SAMPLE`` labelled rows (those with the smallest hashes
of their ids) with texts of at most ``SAMPLE_CHARS`` characters, and
``FEATURES`` candidate features.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import fresh_name, held, map_texts, ship

SAMPLE, SAMPLE_CHARS, FEATURES = 4000, 20_000, 6000
PREFIXES = (4, 5, 6)
CACHE_SIZE = 150_000
THRESHOLD = 0.3

# Identity terms, a kind a line.
IDENTITY = [
    "women men woman man girls boys female male frauen männer femmes hommes mujeres hombres",
    "muslim muslims christian christians jew jews jewish hindu hindus buddhist buddhists atheist atheists catholic catholics",
    "black white asian african european latino hispanic arab indian chinese",
    "gay lesbian straight bisexual trans transgender queer heterosexual homosexual",
    "immigrant immigrants refugee refugees foreigner foreigners migrant migrants natives ausländer étrangers extranjeros",
    "old young elderly blind deaf disabled",
    "german germans french english spanish american americans mexican mexicans polish turkish",
]

#: Everything in ASCII but letters parts words.
_BREAK = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def words_of(data: bytes) -> set[bytes]:
    """The distinct lower-case words of a text's UTF-8 bytes."""
    return set(data.decode("utf-8", "replace").lower().encode().translate(_BREAK).split())


def features_of(word: bytes) -> list[bytes]:
    """The features of a word: itself, and its beginnings by characters."""
    text = word.decode("utf-8", "replace")
    return [word] + [b"^" + text[:n].encode() for n in PREFIXES if len(text) >= n]


def swaps(words: set[bytes], identity: list[str] = IDENTITY) -> list[tuple[bytes, bytes]]:
    """(term, other term of its kind that isn't there) for the identity terms among words, at most four each."""
    out = []
    for terms in (frozenset(line.split()) for line in identity):
        for w in sorted(t for t in (x.encode() for x in terms) if t in words):
            others = sorted(t for t in terms if t.encode() not in words)
            out += [(w, t.encode()) for t in others[:: max(1, len(others) // 4)][:4]]
    return out


@dataclass
class Model:
    """A bias and the features that have weight."""

    bias: float
    weights: dict[bytes, float]
    n_swaps: int = 0

    def scorer(self):
        """A function of a text's bytes that gives its score."""
        weights, bias, cache = self.weights, self.bias, {}

        def active(word: bytes) -> tuple:
            got = tuple(f for f in features_of(word) if f in weights)
            if len(cache) >= CACHE_SIZE:
                cache.clear()
            cache[word] = got
            return got

        def score(data: bytes) -> float:
            found: set = set()
            for w in words_of(data):
                got = cache.get(w)
                if got is None:
                    got = active(w)
                if got:
                    found.update(got)
            z = bias + math.fsum(weights[f] for f in found)
            return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))

        return score


def fit(rows: list[tuple[bytes, int]], l1: float = 0.008, swap_weight: float = 1.0, steps: int = 300, identity: list[str] = IDENTITY) -> Model:
    """Fits the model to (text, label) rows by proximal gradient steps; the same rows give the same model.

    The L1 penalty is ``l1`` over the square root of the number of rows.
    ``identity``: the terms that are swapped, a kind a line; the model tells how
    many swaps the rows had (``n_swaps``).

    Without rows of both labels the model is the constant rate of label 1 (0 without rows).
    """
    n, positives = len(rows), sum(y for _, y in rows)
    if not 0 < positives < n:
        rate = (positives + 0.5) / (n + 1) if n and positives else 1e-3
        return Model(math.log(rate / (1 - rate)), {})
    labels = np.array([y for _, y in rows], float)
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for text, y in rows:
        counts[int(y)].update({f for w in words_of(text) for f in features_of(w)})
    n1, n0 = positives, n - positives

    def strength(f: bytes) -> float:  # log-odds ratio over its standard error
        a, b = counts[1][f] + 0.5, counts[0][f] + 0.5
        c, d = n1 - counts[1][f] + 0.5, n0 - counts[0][f] + 0.5
        return abs(math.log(a * d / (b * c))) / math.sqrt(1 / a + 1 / b + 1 / c + 1 / d)

    common = [f for f in counts[0].keys() | counts[1].keys() if counts[0][f] + counts[1][f] >= 3]
    chosen = sorted(common, key=lambda f: (-strength(f), f))[:FEATURES]
    place = {f: k for k, f in enumerate(chosen)}

    counts[0].clear()
    counts[1].clear()
    found, moved, whose = [], [], []  # a text's chosen features; the features that leave and come with each swap, and its text
    for k, (text, _) in enumerate(rows):
        words = words_of(text)
        found.append(np.array(sorted({place[f] for w in words for f in features_of(w) if f in place}), np.int32))
        had = {f for w in words for f in features_of(w)}
        for a, b in swaps(words, identity):
            # A feature leaves with a word only if no other word has it, and comes only if none had it.
            rest = {f for w in words - {a} for f in features_of(w)}
            moved.append((set(features_of(a)) - rest, set(features_of(b)) - had))
            whose.append(k)
    at, col = np.repeat(np.arange(n), [len(x) for x in found]), np.concatenate(found)
    deltas = [(i, place[f], s) for i, (out, into) in enumerate(moved) for f, s in [*((f, -1.0) for f in out - into), *((f, 1.0) for f in into - out)] if f in place]
    d_at, d_col, d_sign = (np.array([d[k] for d in deltas], t) for k, t in ((0, np.int64), (1, np.int64), (2, float)))

    size, m, owner = len(chosen), max(1, len(moved)), np.array(whose, np.int64)

    def logistic(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    def gradient(w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        z = np.bincount(at, w[col], n) + b
        score = logistic(z)
        r, g = (score - labels) / n, 0.0
        if len(deltas):
            # The score of each sentence and of the same with a term swapped; the penalty is the mean square of their difference.
            own, other = score[owner], logistic(z[owner] + np.bincount(d_at, w[d_col] * d_sign, len(moved)))
            pull = 2 * swap_weight / m * (other - own)
            slope = pull * other * (1 - other)
            g = np.bincount(d_col, slope[d_at] * d_sign, size)
            r = r + np.bincount(owner, slope - pull * own * (1 - own), n)
        return g + np.bincount(col, r[at], size), r.sum()

    w, b = np.zeros(size), math.log(n1 / n0)
    second, momentum = np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):  # Adam steps with a proximal L1 shrink
        g, gb = gradient(w, b)
        momentum = 0.9 * momentum + 0.1 * g
        second = 0.99 * second + 0.01 * g * g
        lr = 0.1 / math.sqrt(1 + t / 50)
        metric = np.sqrt(second / (1 - 0.99**t)) + 1e-6
        w = w - lr * (momentum / (1 - 0.9**t)) / metric
        shrink = lr * l1 / math.sqrt(n) / np.maximum(metric, 1e-4)
        w = np.sign(w) * np.maximum(np.abs(w) - shrink, 0)
        b -= 2.0 * gb
    return Model(float(b), {f: float(x) for f, x in zip(chosen, w, strict=True) if x}, len(moved))


def held_out(id_col: str) -> Column:
    """True for ids whose decimal text has a CRC-32 of remainder 2 by 4; false for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, identity: list[str] = IDENTITY) -> Model:
    """Fits a model to labelled rows that aren't held out.

    Of a row's contradicting labels the larger counts.  Null ids, labels and
    texts aren't sampled.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    # At most `sample` rows, so these can be broadcast.
    few = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).where(F.length("t") <= SAMPLE_CHARS)
    rows = texts.join(F.broadcast(few), "id").select("id", F.col("t").cast("binary"), F.col("y").cast("int")).orderBy("id", "t").limit(sample).collect()
    return fit([(bytes(r[1]), int(r[2] > 0)) for r in rows], identity=identity)


def score_toxicity(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``held_out``, ``score`` and ``predicted`` (1 if the score is at least 0.3).

    Null or empty text: the score of a text without words.  Repeated rows and
    null ids: a row each.  Empty table: no row.  Other columns aren't read.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)  # bounded by FEATURES

    def make():
        score = sent.value.scorer()
        return lambda data: [(score(data),)]

    rows = map_texts(df, make, [("score", "double")], id_col, text_col)
    return rows.select(F.col(id_col), held_out(id_col).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, with its columns, that aren't predicted toxic.  Edge cases as in :func:`score_toxicity`."""
    ship(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)
    name = fresh_name(df, "score")

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        loaded = held("toxicity")
        if "score" not in loaded or loaded["model"] != sent.value:
            loaded["model"], loaded["score"] = sent.value, sent.value.scorer()
        one = loaded["score"]
        return pd.Series([one(x) for x in texts], dtype="float64")

    raw = F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b"").cast("binary"))
    return df.withColumn(name, score(raw)).where(F.col(f"`{name}`") < THRESHOLD).select(*[F.col(f"`{c}`") for c in df.columns])
