"""Toxicity by multiple-instance learning.

A document is a bag of sentences. The probability of a sentence with a telling word
is a logistic function of its words; the document's is their noisy-or with a leak,
1 - (1 - leak) * product(1 - p). The leak stands for all sentences without a telling
word together. Only document
labels are known, so the gradient reaches a sentence through the product. After
training the same sentence scores say where the offence is, and a document's score is the noisy-or of
its offending sentences, those with a p of a half or more. Of the others only the likeliest counts, by so much that it can't
make a document toxic: many mild sentences don't add up, so length makes nothing toxic.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import sampling, worker
from .columns import numbered, place
from .hashing import column, slices

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")


STEMS = range(4, 9)


def features(word: str) -> list[str]:
    """The word itself, marked by a trailing space, and its beginnings, which inflected forms share."""
    return [word + " ", *(word[:n] for n in STEMS if n <= len(word))]


class Words(dict):
    """What each word adds to its sentence's logit, worked out once; None if it tells nothing."""

    def __init__(self, weights: dict[str, float], most: int = 200_000, longest: int = 64):
        super().__init__()
        self.weights, self.most, self.longest = weights, most, longest

    def __missing__(self, word: str) -> float | None:
        own = [self.weights[f] for f in features(word) if f in self.weights]
        value = sum(own) if own else None
        if len(word) <= self.longest:  # longer ones are worked out each time
            if len(self) >= self.most:
                self.clear()
            self[word] = value
        return value


@dataclass
class Model:
    leak: float  # a logit, as are the following
    bias: float
    weights: dict[str, float]  # by feature
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def __post_init__(self) -> None:
        self.words = Words(self.weights)

    def __reduce__(self):
        return Model, (self.leak, self.bias, self.weights, self.name)

    def live(self) -> Model:
        """This worker's copy, which keeps the words of earlier tasks."""
        return worker.keep(f"toxicity {self.name}", lambda: self)

    def sentences(self, text: str) -> Iterator[tuple[int, int, float]]:
        """(start, end, logit) of each sentence that has a telling word."""
        get = self.words.__getitem__
        for m in SENTENCE.finditer(text):
            telling = [x for x in map(get, WORD.findall(m[0].lower())) if x is not None]
            if telling:
                yield m.start(), m.end(), self.bias + sum(telling)

    def score(self, text: str | None) -> tuple[float, str]:
        """The document's probability and its sentences more likely toxic than not."""
        none, where, mild = -float(np.logaddexp(0.0, self.leak)), [], -np.inf
        for a, b, z in self.sentences(text or ""):
            if z >= 0:
                none -= float(np.logaddexp(0.0, z))
                where.append(f"{a}:{b}")
            else:
                mild = max(mild, z)
        if mild > -np.inf:
            # below a half with the leak: (1 - leak) * (1 - room * p) > 1/2 for p < 1/2
            room = max(0.0, -float(np.expm1(self.leak)))
            none += float(np.log1p(-room * np.exp(-np.logaddexp(0.0, -mild))))
        return min(1.0, max(0.0, -float(np.expm1(none)))), ",".join(where)


def log_none(logits: np.ndarray) -> np.ndarray:
    """log(1 - p) of each logit."""
    return -np.logaddexp(0.0, logits)


def log_tail(hits: int, draws: int, share: float) -> float:
    """Log probability of ``hits`` or more in ``draws``; Chernoff's bound, which holds for any size."""
    rate = hits / draws
    if rate <= share or share >= 1:
        return 0.0
    gain = rate * np.log(rate / share) + ((1 - rate) * np.log((1 - rate) / (1 - share)) if rate < 1 else 0.0)
    return -float(draws * gain)


def bag(text: str, shared: dict[str, str] | None = None) -> list[tuple[str, ...]]:
    """Sentences as their words; with ``shared``, a word that occurs again is the same object, which saves most of the memory."""
    same = (lambda w: w) if shared is None else (lambda w: shared.setdefault(w, w))
    return [tuple(map(same, words)) for m in SENTENCE.finditer(text) if (words := WORD.findall(m[0].lower()))]


def telling(bags: list[list[tuple[str, ...]]], labels: list[int], doubt: float) -> list[str]:
    """Features that toxic documents' sentences hold more often than chance explains, ``doubt`` over all; the rest is noise for the fit.

    Each sentence counts once, or the words of a text with many copies would seem telling.
    """
    label_of: dict[tuple[str, ...], bool] = {}
    for own, label in zip(bags, labels, strict=True):
        for words in own:
            label_of[words] = label_of.get(words, False) or bool(label)
    seen, toxic = Counter(), Counter()
    for words, label in label_of.items():
        own = {f for w in words for f in features(w)}
        seen.update(own)
        if label:
            toxic.update(own)
    tested = [f for f in toxic if toxic[f] >= 3]
    usual = sum(label_of.values()) / max(1, len(label_of))
    return sorted(f for f in tested if log_tail(toxic[f], seen[f], usual) + np.log(len(tested)) < np.log(doubt))


@dataclass
class Bags:
    """Documents as sentences with telling words: for each sentence its document, for each of its features (at, col)."""

    y: np.ndarray
    doc: np.ndarray
    at: np.ndarray
    col: np.ndarray
    features: int

    @classmethod
    def of(cls, bags: list[list[tuple[str, ...]]], labels: list[int], vocabulary: list[str]) -> Bags:
        number = {w: k for k, w in enumerate(vocabulary)}
        doc, at, col = [], [], []
        for d, own in enumerate(bags):
            for words in own:
                cols = [number[f] for w in words for f in features(w) if f in number]
                if cols:
                    at += [len(doc)] * len(cols)
                    col += cols
                    doc.append(d)
        whole = lambda x: np.asarray(x, dtype=np.int64)
        return cls(np.asarray(labels, dtype=float), whole(doc), whole(at), whole(col), len(vocabulary))

    def likelihood(self, theta: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
        """Mean log likelihood of the labels, less the penalty, and its gradient; theta: weights, bias, leak."""
        w, bias, leak = theta[:-2], theta[-2], theta[-1]
        n = len(self.y)
        z = np.bincount(self.at, w[self.col], len(self.doc)) + bias
        none = np.bincount(self.doc, log_none(z), n) + log_none(leak)
        some = np.maximum(-np.expm1(none), 1e-12)
        value = np.where(self.y > 0, np.log(some), none).mean() - penalty * (w @ w) / 2
        pull = np.where(self.y > 0, np.exp(none) / some, -1.0)
        slope = pull[self.doc] / (1 + np.exp(-z))
        grad = np.concatenate([np.bincount(self.col, slope[self.at], self.features), [slope.sum(), pull.sum() / (1 + np.exp(-leak))]]) / n
        grad[:-2] -= penalty * w
        return float(value), grad


def train(texts: list[str], labels: list[int], rounds: int = 400, rate: float = 0.05, penalty: float = 1e-5, doubt: float = 0.05) -> Model:
    """Fits the sentence scores to the documents' labels. Without two classes the score is constant.

    Every feature that passes the test of ``telling`` counts, however many.
    """
    positive, n = float(sum(labels)), len(labels)
    if not n or positive in (0.0, float(n)):
        rate_of = (positive + 1) / (n + 2)
        return Model(float(np.log(rate_of / (1 - rate_of))), 0.0, {})
    shared: dict[str, str] = {}
    bags = [bag(t, shared) for t in texts]
    vocabulary = telling(bags, labels, doubt)
    data = Bags.of(bags, labels, vocabulary)
    theta = np.zeros(len(vocabulary) + 2)
    theta[-2:] = -2.0, np.log(positive / n / 10)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        _, grad = data.likelihood(theta, penalty)
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        theta += rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Model(float(theta[-1]), float(theta[-2]), dict(zip(vocabulary, theta[:-2].tolist(), strict=True)))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, text: str, id_col: str, label: str, max_rows: int, max_bytes: int) -> tuple[list[str], list[int]]:
    """The labelled texts to learn from: not held out, ``max_rows`` of them by their hash, ``max_bytes`` in all."""
    own, marks = numbered(docs), numbered(labels)
    t, k = F.col(place(docs, text)), place(docs, id_col)
    marks = marks.filter(F.col(place(labels, label)).isNotNull()).groupBy(F.col(place(labels, id_col)).alias("id")).agg(F.max(place(labels, label)).cast("int").alias("label"))
    rows = own.filter(~held_out(k) & t.isNotNull()).select(F.col(k).alias("id"), F.xxhash64(t).alias("h"), F.octet_length(t).alias("size"), t.alias("text"))
    # ids and hashes are joined and chosen; only the chosen rows' texts travel
    known = rows.select("id", "h", "size").join(marks, "id").groupBy("h").agg(F.max("label").alias("label"), F.max("size").alias("size"))
    picked = sampling.chosen(known.select(F.lit(0).alias("g"), "h", "size"), max_rows, max_bytes)
    if not picked:
        return [], []
    keys = docs.sparkSession.createDataFrame([(h,) for _, h in picked], "h long")
    label_of = {r.h: int(r.label > 0) for r in known.join(F.broadcast(keys), "h").collect()}  # bounded by the sample's size
    found = sampling.fetched(rows.withColumn("g", F.lit(0)), picked, "text")
    return [r.text for r in found], [label_of[r.h] for r in found]


def score(docs: DataFrame, model: Model, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.live()
        for batch in batches:
            for part in slices(batch, "text", 2_000_000):
                found = [own.score(t) for t in column(part, "text").to_pylist()]
                scores = [s for s, _ in found]
                cols = [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array([w for _, w in found], pa.string())]
                yield pa.RecordBatch.from_arrays([column(part, "id"), column(part, "held_out"), *cols], names=["id", "held_out", "score", "predicted", "sentences"])

    worker.small_batches(docs.sparkSession)
    own, k = numbered(docs), place(docs, id_col)
    kind = own.schema[k].dataType.simpleString()
    rows = own.select(F.col(k).alias("id"), held_out(k).alias("held_out"), F.col(place(docs, text)).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int, sentences string").withColumnRenamed("id", id_col)


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "toxic", max_rows: int = 6000, max_bytes: int = 48 << 20) -> DataFrame:
    """Scores every whole text; learns from at most ``max_rows`` different labelled texts, ``max_bytes`` bytes in all.

    Returns, per row: the id, held_out (crc32 of the id as text is 0 modulo 5; such
    rows are never learned from), score, predicted (1 from 0.5 on) and sentences,
    ``start:end`` of those more likely toxic than not; unless the leak is a half or more, a text is predicted toxic if and only if it has one. Null, empty and wordless texts, and
    texts of any length without a telling word, get the leak as their score. Null ids are not held out and
    have no label. If an id or a text has several labels, the largest counts; repeated rows
    are scored alike. Without labels of both kinds every text gets one score. Other columns
    of both tables are ignored, whatever their names; an empty table gives no rows.
    """
    model = train(*sample(docs, labels, text, id_col, label, max_rows, max_bytes))
    return score(docs, model, text, id_col)
