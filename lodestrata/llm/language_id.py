"""Language identification with segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A
word's likelihood is the sum, over all ways to cut it into pieces, of the product
of their probabilities: one forward pass over the word. Piece probabilities are
fitted with expectation maximisation (forward and backward sums) on a bounded
sample of labelled texts. A text's score is the sum over its words, which are
lower-cased runs of letters.

Every piece has at least ``FLOOR`` divided by the vocabulary's size in every language; a
letter that is no piece has ``UNKNOWN`` in all of them, and the mark of a word's beginning by
itself ``FLOOR``: what no language was trained on speaks for none. Sums don't vanish: in words of up to ``SHORT`` letters each letter
counts ``SCALE`` times, which the logarithm takes back; longer words are worked off
letter by letter, and the sums are scaled whenever they get small.
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
from .hashing import U, slices

WORD = re.compile(r"[^\W\d_]+")
MARK = "▁"
BASE = 0xC2B2AE3D27D4EB4F
SHORT = 48
SCALE = 1e4
FLOOR = 1e-3
UNKNOWN = 1e-8
UNDETERMINED = "und"


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def has_letter(words: list[str]) -> bool:
    return any(c.isalpha() for w in words for c in w)


def vocabulary(path: str) -> list[str]:
    """Pieces of a public sentencepiece model that can stand in a word."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(k).lower() for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_byte(k) or model.is_unknown(k))}
    return sorted(p for p in pieces if WORD.fullmatch(p.removeprefix(MARK) or "a"))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    rows = []
    for b in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(n, b, dtype=U)
        p[:1] = 1
        rows.append(np.multiply.accumulate(p))
    return rows[0], rows[1]


def _codes(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(words), length)


def _hash(pieces: list[str]) -> np.ndarray:
    out = np.zeros(len(pieces), dtype=U)
    by_length: dict[int, list[int]] = {}
    for k, p in enumerate(pieces):
        by_length.setdefault(len(p), []).append(k)
    power, _ = powers(max(by_length))
    for n, at in by_length.items():
        out[at] = (_codes([pieces[k] for k in at], n).astype(U) * power[:n]).sum(axis=1, dtype=U)
    return out


@dataclass
class Lattice:
    """Numbers of the pieces at each place of equally long words; the last number means an unknown letter, -1 no piece."""

    keys: np.ndarray
    order: np.ndarray
    size: int
    longest: int

    @classmethod
    def of(cls, pieces: list[str]) -> Lattice:
        h = _hash(pieces)
        order = np.argsort(h)
        return cls(h[order], order, len(pieces), max(map(len, pieces)))

    def found(self, h: np.ndarray, length: int) -> np.ndarray:
        k = np.searchsorted(self.keys, h)
        k[k == self.size] = 0
        return np.where(self.keys[k] == h, self.order[k], self.size if length == 1 else -1)

    def at(self, words: list[str]) -> list[list[tuple[int, np.ndarray]]]:
        """For each end j: (start i, piece numbers of word[i:j])."""
        length = len(words[0])
        power, inverse = powers(length + 1)
        total = np.zeros((len(words), length + 1), dtype=U)
        np.cumsum(_codes(words, length).astype(U) * power[:length], axis=1, out=total[:, 1:])
        out = []
        for j in range(1, length + 1):
            here = []
            for i in range(max(0, j - self.longest), j):
                found = self.found((total[:, j] - total[:, i]) * inverse[i], j - i)
                if (found >= 0).any():
                    here.append((i, found))
            out.append(here)
        return out

    def stretches(self, word: str, step: int = 4096) -> Iterator[np.ndarray]:
        """For the ends of a long word, ``step`` at a time: numbers of the pieces of 1, 2, ... letters that end there."""
        codes = _codes([word], len(word))[0].astype(U)
        power, inverse = powers(step + self.longest + 1)
        for first in range(0, len(word), step):
            low, high = max(0, first - self.longest), min(len(word), first + step)
            total = np.zeros(high - low + 1, dtype=U)
            np.cumsum(codes[low:high] * power[: high - low], out=total[1:])
            ends = np.arange(first + 1, high + 1) - low
            out = np.full((len(ends), self.longest), -1, dtype=np.int64)
            for n in range(1, self.longest + 1):
                own = ends >= n
                starts = ends[own] - n
                out[own, n - 1] = self.found((total[ends[own]] - total[starts]) * inverse[starts], n)
            yield out


def scaled(pieces: list[str], probs: np.ndarray) -> np.ndarray:
    """Probabilities of the pieces, the unknown letter and, as nought, no piece, times SCALE for each letter."""
    letters = np.array([*(len(p) for p in pieces), 1], dtype=float)
    return np.vstack([probs * SCALE ** letters[:, None], np.zeros(probs.shape[1])])


@dataclass
class Model:
    languages: list[str]
    pieces: list[str]
    probs: np.ndarray  # pieces and the unknown letter, by language
    cache_bytes: int = 32 << 20
    lattice: Lattice | None = None
    table: np.ndarray | None = None
    cache: dict[str, int] = field(default_factory=dict)
    scores_of: np.ndarray | None = None
    used: int = 0
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def live(self) -> Model:
        """This worker's copy of the model, which keeps the words scored by earlier tasks."""
        return worker.keep(f"language {self.name}", lambda: self)

    def __getstate__(self):
        return self.__dict__ | {"cache": {}, "used": 0, "scores_of": None, "lattice": None, "table": None}

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log likelihood of each word in each language."""
        if self.lattice is None:
            self.lattice = Lattice.of(self.pieces)
            self.table = scaled(self.pieces, self.probs)
        out = np.zeros((len(words), len(self.languages)))
        for at in by_length(words):
            length = len(words[at[0]]) + 1
            if length > SHORT + 1:
                out[at] = [self._long(MARK + words[k]) for k in at]
                continue
            alpha = [np.ones((len(at), len(self.languages)))]
            for here in self.lattice.at([MARK + words[k] for k in at]):
                alpha.append(sum(alpha[i] * self.table[found] for i, found in here))
            out[at] = np.log(alpha[-1]) - length * np.log(SCALE)
        return out

    def _long(self, word: str) -> np.ndarray:
        """The same sum for a word of any length, scaled on the way; memory doesn't grow with the word."""
        longest = self.lattice.longest
        last = np.zeros((longest, len(self.languages)))  # the sums up to the last letters, the newest first
        last[0] = 1.0
        log = np.zeros(len(self.languages))
        for found in self.lattice.stretches(word):
            for probs in self.table[found]:
                new = (last * probs).sum(axis=0)
                last[1:] = last[:-1]
                last[0] = new
                if new.min() < 1e-60 or new.max() > 1e60:
                    last /= new
                    log += np.log(new)
        return log + np.log(last[0]) - len(word) * np.log(SCALE)

    def scores(self, texts: list[list[str]]) -> np.ndarray:
        """Log likelihood of each list of words in each language."""
        cost = 160 + 12 * len(self.languages)  # of an entry, roughly, besides its letters
        missing = {w for words in texts for w in words if w not in self.cache}
        size = sum(map(len, missing)) * 2 + cost * len(missing)
        if self.used + size > self.cache_bytes:
            self.cache, self.scores_of, self.used = {}, None, 0
            missing = {w for words in texts for w in words}
            size = sum(map(len, missing)) * 2 + cost * len(missing)
        if missing:
            new = list(missing)
            start = len(self.cache)
            self.used += size
            self.cache.update(zip(new, range(start, start + len(new)), strict=True))
            scores = self.word_scores(new)
            self.scores_of = scores if self.scores_of is None or not start else np.concatenate([self.scores_of, scores])
        out = np.zeros((len(texts), len(self.languages)))
        for k, words in enumerate(texts):
            if words:
                out[k] = self.scores_of[np.fromiter(map(self.cache.__getitem__, words), dtype=np.int64, count=len(words))].sum(axis=0)
        return out

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and posterior, with equal priors, of each text."""
        words = [words_of(t) if t else [] for t in texts]
        langs, scores = [], []
        for own, logs in zip(words, self.scores(words) if self.languages else [None] * len(words), strict=True):
            if logs is None or not has_letter(own):
                langs.append(UNDETERMINED)
                scores.append(0.0)
                continue
            best = int(np.argmax(logs))
            langs.append(self.languages[best])
            scores.append(float(1 / np.exp(logs - logs[best]).sum()))
        return langs, scores


def by_length(words: list[str], most: int = 20_000) -> Iterator[np.ndarray]:
    """Indexes of equally long words, ``most`` at a time."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        for k in range(0, len(at), most):
            yield at[k : k + most]


def train(texts: list[str], langs: list[str], pieces: list[str], rounds: int = 4) -> Model:
    """Expectation maximisation over all segmentations, one language at a time. Longer words are learned from in stretches of SHORT letters."""
    languages = sorted(set(langs))
    model = Model(languages, pieces, np.zeros((len(pieces) + 1, len(languages))))
    lattice = Lattice.of(pieces)
    counts = {lang: Counter() for lang in languages}
    for t, lang in zip(texts, langs, strict=True):
        counts[lang].update(w[k : k + SHORT] for w in words_of(t) for k in range(0, len(w), SHORT))
    none = len(pieces) + 1
    fixed = {pieces.index(MARK): FLOOR} if MARK in pieces else {}
    for column, lang in enumerate(languages):
        words = list(counts[lang])
        weight = np.array([counts[lang][w] for w in words], dtype=float)
        lattices = [(at, lattice.at([MARK + words[k] for k in at])) for at in by_length(words)]
        probs = np.append(np.full(len(pieces), 1.0 / len(pieces)), UNKNOWN)
        for _ in range(rounds):
            table = scaled(pieces, probs[:, None])[:, 0]
            expected = np.zeros(none)
            for at, ends in lattices:
                alpha = [np.ones(len(at))]
                for here in ends:
                    alpha.append(sum(alpha[i] * table[found] for i, found in here))
                beta = [np.zeros(len(at)) for _ in alpha]
                beta[-1] = weight[at] / alpha[-1]
                for j in range(len(ends), 0, -1):
                    for i, found in ends[j - 1]:
                        flow = beta[j] * table[found]
                        beta[i] += flow
                        expected += np.bincount(np.where(found < 0, none, found), alpha[i] * flow, none + 1)[:-1]
            expected[list(fixed)] = 0
            total = expected[:-1].sum()
            probs[:-1] = FLOOR / len(pieces) + (1 - FLOOR) * (expected[:-1] / total if total else 1 / len(pieces))
            probs[list(fixed)] = list(fixed.values())
        model.probs[:, column] = probs
    return model


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, text: str, id_col: str, lang: str, per_language: int, max_bytes: int) -> tuple[list[str], list[str]]:
    """The labelled texts to learn from: not held out, ``per_language`` of each language by their hash, one at least, ``max_bytes`` in all."""
    own = numbered(docs)
    t = F.col(place(docs, text))
    usable = own.filter(~held_out(place(docs, id_col)) & F.col(place(docs, lang)).isNotNull() & t.rlike(r"\p{L}"))
    rows = usable.select(F.col(place(docs, lang)).alias("g"), F.xxhash64(t).alias("h"), F.octet_length(t).alias("size"), t.alias("text"))
    picked = sampling.chosen(rows.select("g", "h", "size"), per_language, max_bytes)
    found = sampling.fetched(rows, picked, "text") if picked else []
    return [r.text for r in found], [r.g for r in found]


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with its columns named c0, c1, ..., and lang_pred and score."""
    worker.small_batches(docs.sparkSession)
    own = numbered(docs)
    at = place(docs, text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = model.live()
        for batch in batches:
            for part in slices(batch, at, 2_000_000):
                langs, scores = here.judge(part.column(part.schema.get_field_index(at)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*part.schema.names, "lang_pred", "score"])

    return own.mapInArrow(run, own.limit(0).selectExpr("*", "'' AS lang_pred", "0D AS score").schema)


def fit(docs: DataFrame, pieces: list[str], text: str = "text", id_col: str = "doc_id", lang: str = "lang", per_language: int = 300, max_bytes: int = 32 << 20) -> Model:
    return train(*sample(docs, text, id_col, lang, per_language, max_bytes), pieces)


def identify(docs: DataFrame, pieces: list[str], text: str = "text", id_col: str = "doc_id", lang: str = "lang", **bounds) -> DataFrame:
    """Predicts the language of every whole text, however long.

    Learns from at most ``per_language`` (300) labelled texts of each language, however rare,
    ``max_bytes`` (32 MB) in all beside each language's first text, never from held-out rows (crc32 of
    the id as text is 0 modulo 5). Returns, per row: the id, held_out, lang_pred and
    score, the posterior of lang_pred with equal priors. Null, empty and letterless
    texts are ``und`` with score 0, as is everything where no row is labelled. Null
    ids are not held out. Repeated rows are predicted alike; ties go to the first
    language in the alphabet, so does a text in letters that no language was trained
    on, with the score of a guess. Other columns are ignored, whatever their names.
    An empty table gives no rows.
    """
    model = fit(docs, pieces, text, id_col, lang, **bounds)
    own = numbered(docs)
    k = place(docs, id_col)
    rows = own.select(F.col(k).alias("id"), held_out(k).alias("held_out"), F.col(place(docs, text)).alias("text"))
    return predict(rows, model).select(F.col("c0").alias(id_col), F.col("c1").alias("held_out"), "lang_pred", "score")


def certain(docs: DataFrame, pieces: list[str], least: float, text: str = "text", id_col: str = "doc_id", lang: str = "lang", **bounds) -> DataFrame:
    """The rows of ``docs`` whose language has a score of ``least`` or more, with all their columns.

    Null, empty and letterless texts go; where no row is labelled, all rows go.
    Null ids, repeated rows, long texts and an empty table are no trouble.
    """
    seen = predict(docs, fit(docs, pieces, text, id_col, lang, **bounds), text)
    return seen.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)).drop("lang_pred", "score").toDF(*docs.columns)
