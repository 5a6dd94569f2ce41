"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence scores sigmoid(bias + word weights), a document
1 - product(1 - sentence scores).  Only document labels train it; the sentences that carry a
high score are then reported with their places.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, clear_of

_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
#: Lengths of the word starts that are features beside the words: unseen words of a known family count too.
STARTS = (4, 5, 6, 7)
_TRIM = ".,;:!?\"'()[]{}|*#$%&"


def sentences(text: str) -> list[tuple[int, int]]:
    """Places of the sentences; they end at ``.``, ``!`` or ``?`` before white space and at line ends."""
    found, at = [], 0
    for m in _SENTENCE.finditer(text):
        if m.start() > at:
            found.append((at, m.start()))
        at = m.end()
    return [*found, (at, len(text))] if at < len(text) else found


def features(text: str) -> list[str]:
    """Lower-cased words without surrounding punctuation, and the starts of longer words, marked by a star."""
    found = []
    for x in WORD.findall(text.lower()):
        if w := x.strip(_TRIM):
            found.append(w)
            found += [w[:n] + "*" for n in STARTS if len(w) > n]
    return found


class Model:
    """Feature weights and the bias of a sentence."""

    def __init__(self, weights: dict[str, float], bias: float) -> None:
        self.weights, self.bias = weights, bias
        #: First characters of everything that has a weight; a word that starts otherwise needs no further look.
        self.heads = frozenset((f[:-1] if f.endswith("*") else f)[: STARTS[0]] for f in weights)
        self.seen: dict[str, tuple[str, ...]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"seen": {}}

    def of_word(self, x: str) -> tuple[str, ...]:
        """The features of a lower-cased word that have a weight; frequent words are remembered."""
        w, weights = x.strip(_TRIM), self.weights
        found: tuple[str, ...] = ()
        if w[: STARTS[0]] in self.heads:
            found = tuple(f for f in (w, *(w[:n] + "*" for n in STARTS if len(w) > n)) if f in weights)
        if len(self.seen) < 150_000:
            self.seen[x] = found
        return found

    def known(self, sentence: str) -> set[str]:
        """The features of a sentence that have a weight."""
        found, get = set(), self.seen.get
        for x in WORD.findall(sentence.lower()):
            own = get(x)
            if own is None:
                own = self.of_word(x)
            if own:
                found.update(own)
        return found

    def score(self, text: str) -> tuple[float, int, list[tuple[int, int, float]]]:
        """(document score, sentences, offending sentences as (start, end, score)); a feature counts once in a sentence."""
        spans = sentences(text)
        clean = -float(np.log1p(np.exp(self.bias)))  # log(1 - score) of a sentence without known words
        rest, bad = 0.0, []
        for start, end in spans:
            found = self.known(text[start:end])
            if not found:
                rest += clean
                continue
            z = self.bias + sum(self.weights[f] for f in sorted(found))
            rest += float(-np.logaddexp(0, z))
            p = 1 / (1 + np.exp(-z)) if z > -700 else 0.0
            if p >= 0.5:
                bad.append((start, end, float(p)))
        return max(0.0, float(-np.expm1(rest))), len(spans), bad


def fit(rows: list[tuple[str, int]], vocabulary: int = 4096, rounds: int = 300, rate: float = 0.3, l2: float = 1e-4, least_gap: float = 2.5, prior: float = 100.0) -> Model:
    """Adam on the noisy-or likelihood; words are the ``vocabulary`` ones that tell the labels apart best,
    by at least ``least_gap`` standard errors of the log ratio of their shares.  Where rows of label
    1 are fewer than half as many as the others they weigh more, up to half of what they lack;
    ``prior`` rows of each kind are reckoned in first, so that few rows are weighed alike.

    Without rows of both labels the model scores every text 0.
    """
    y = np.array([v for _, v in rows], dtype=float)
    if not len(y) or y.min() == y.max():
        return Model({}, -1e9)
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for text, v in rows:
        seen[int(v)].update(set(features(text)))
    n1, n0 = y.sum(), len(y) - y.sum()

    def gap(w: str) -> float:
        a, b = seen[1][w], seen[0][w]
        p, q = (a + 0.5) / (n1 + 1), (b + 0.5) / (n0 + 1)
        return abs(np.log(p / q)) / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))

    kept = sorted((w for w in {*seen[0], *seen[1]} if seen[0][w] + seen[1][w] >= 3 and gap(w) >= least_gap), key=lambda w: (-gap(w), w))[:vocabulary]
    index = {w: k for k, w in enumerate(kept)}
    bag, sent, word, n = [], [], [], 0
    for k, (text, _) in enumerate(rows):
        for start, end in sentences(text):
            own = {index[w] for w in features(text[start:end]) if w in index}
            bag.append(k)
            sent += [n] * len(own)
            word += own
            n += 1
    bag_, sent_, word_ = np.array(bag, dtype=np.int64), np.array(sent, dtype=np.int64), np.array(word, dtype=np.int64)
    share = max(1.0, (n0 + prior) / (2 * n1 + prior))
    w = np.zeros(len(kept) + 1)
    w[-1] = -3.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        z = np.bincount(sent_, weights=w[word_], minlength=n) + w[-1]
        p = 1 / (1 + np.exp(-z))
        clean = np.exp(np.bincount(bag_, weights=-np.logaddexp(0, z), minlength=len(y)))
        whole = np.clip(1 - clean, 1e-9, 1)
        pull = np.where(y == 1, -share * np.clip(clean, 0, 1) / whole, 1.0) / len(y)
        dz = p * pull[bag_]
        g = np.append(np.bincount(word_, weights=dz[sent_], minlength=len(kept)) + l2 * w[:-1], dz.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return Model({x: float(k) for x, k in zip(kept, w[:-1], strict=True) if abs(k) > 1e-6}, float(w[-1]))


def held_out(doc_id="doc_id"):
    """Rows kept from training: crc32 of the id as text, modulo 5, is 0.  A null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, sample: int = 3000, longest: int = 200_000, characters: int = 30_000_000) -> Model:
    """Fits the model on at most ``sample`` labelled rows of each label, outside the held-out fifth.

    Rows are taken in the order of a hash of their id, so the sample depends on ids only; longer
    texts than ``longest`` are not trained on, nor what comes after ``characters`` in all: that
    bounds what the task gets that fits the model.  Null labels and ids are passed over, a document with several
    labels counts as toxic when one of them says so, and of several texts under one id the first
    in their order counts.  Empty tables give a model that scores every text 0.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("__y"))
    order = F.xxhash64(F.col("doc_id"))
    picked = own.where("__y = 1").orderBy(order).limit(sample).unionByName(own.where("__y = 0").orderBy(order).limit(sample))
    text = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("__t")).where(F.length("__t") <= longest)
    rows = text.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "__y").agg(F.min("__t").alias("__t"))
    # a window over 2 * sample rows at most
    rows = rows.withColumn("__sum", F.sum(F.length("__t")).over(Window.orderBy(order, "doc_id"))).where(F.col("__sum") <= characters)
    # the fit is a task's work on this bounded sample; the driver only gets the words' weights
    got = rows.orderBy("doc_id").select("__t", "__y").coalesce(1).mapInPandas(_fitted, "word string, weight double").collect()
    return Model({r.word: r.weight for r in got if r.word is not None}, next((r.weight for r in got if r.word is None), -1e9))


def _fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of texts and labels to the model's words with their weights, and its bias without a word."""
    model = fit([row for b in batches for row in zip(b["__t"], b["__y"], strict=True)])
    yield pd.DataFrame({"word": pd.Series([*model.weights, None], dtype=object), "weight": [*model.weights.values(), model.bias]})


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep``, score, predicted, sentences and the offending ones' places of every row; nothing is shuffled.

    An empty or null text has no sentence and the score 0.  Rows are independent: repeated ones and
    null ids are rows like others, an empty table gives none.  ``keep`` must not name a column that
    is added (ValueError); other columns are not looked at, whatever their names.
    """
    clear_of(keep, "score", "predicted", "n_sentences", "offending")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sent.value
        for b in it:
            rows = []
            for t in b["__text"]:
                s, n, bad = own.score(t or "")
                rows.append((s, int(s >= 0.5), n, ",".join(f"{x}:{y}" for x, y, _ in bad)))
            yield pd.concat([b.drop(columns="__text"), pd.DataFrame(rows, columns=["score", "predicted", "n_sentences", "offending"])], axis=1)

    kept = docs.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema), "score double, predicted int, n_sentences long, offending string"])
    return kept.mapInPandas(batches, schema)


def rejected(model: Model):
    """A column function: true for texts that score 0.5 or more."""

    @F.pandas_udf("boolean")
    def reject(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t or "")[0] >= 0.5 for t in texts], dtype=bool)

    return reject
