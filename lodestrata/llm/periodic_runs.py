"""Periodic runs of words by block matching.

A run is a stretch of words that repeats itself with some smallest period q and that can't be made
longer. Every run of at least 2q words holds, among its first words, an aligned block of L words with
L a power of two and 2L - 1 <= q <= 4L - 2, and a copy of that block exactly q words on. So for each L the aligned blocks are
the keys of an automaton over word numbers, which searches the document where copies can lie;
a block and an occurrence at a distance of that scale are a seed, which is extended word by word in both
directions. What has the distance as its smallest period and is long enough is a run.

Blocks that can't be part of a run are left out of the automaton: those with a group of four
words that doesn't occur again within the scale's distances, and those whose
copies in reach all lie in one run of a shorter period that is already known.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import worker
from .columns import numbered, place
from .hashing import column, groups_of, mix

QUAD = 4
SHORTEST = 12  # in shorter runs no four words need to come twice
FAR = np.int64(1) << 60


def next_quad(w: np.ndarray) -> np.ndarray | None:
    """For each word, how many words on the four words from it on come next, by hash; None if no four words come twice."""
    x = w.astype(np.uint64)
    key = x[:-3]
    for k in (1, 2, 3):
        key = mix(key, k) + x[k : len(x) - 3 + k]
    order = np.argsort(key, kind="stable")
    again = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    if not len(again):
        return None
    out = np.full(len(key), FAR)
    out[order[again]] = order[again + 1] - order[again]
    return out


def prime_factors(n: int) -> list[int]:
    out, f = [], 2
    while f * f <= n:
        if n % f == 0:
            out.append(f)
            while n % f == 0:
                n //= f
        f += 1
    return out + [n] * (n > 1)


def _stretch(w: np.ndarray, i: int, j: int) -> int:
    """How many words agree from i and j on."""
    k, step, most = 0, 32, len(w) - j
    while k < most:
        m = min(step, most - k)
        other = w[i + k : i + k + m] != w[j + k : j + k + m]
        at = int(other.argmax())
        if other[at]:
            return k + at
        k, step = k + m, step * 4
    return most


class Finder:
    """The runs of one document's word numbers."""

    def __init__(self, w: np.ndarray, least: int):
        self.w, self.back, self.least = w, w[::-1], least
        self.numbers: list[int] = []
        self.runs: set[tuple[int, int, int]] = set()  # start, length, period

    def find(self) -> list[tuple[int, int, int]]:
        n = len(self.w)
        if n < self.least or (ahead := next_quad(self.w)) is None:
            return []
        self.numbers = self.w.tolist()
        for length, low, high in self.scales(n):
            keys = self.blocks(ahead, length, low, high)
            if len(keys):
                self.extend(*self.seeds(keys, length, low, high), length)
        return sorted(self.runs, key=lambda r: (r[0], r[2]))

    def scales(self, n: int) -> Iterator[tuple[int, int, int]]:
        """Block length, shortest and longest distance. Runs of 12 words or more hold an aligned block of 4 before their last period if that is not 6."""
        yield 2, 6, 6
        length = QUAD
        while (low := 1 if length == QUAD else 2 * length - 1) <= n // 2:
            yield length, low, min(4 * length - 2, n // 2)
            length *= 2

    def blocks(self, ahead: np.ndarray, length: int, low: int, high: int) -> np.ndarray:
        """Numbers of the aligned blocks that may seed a run."""
        n = len(self.w)
        if length < QUAD:
            near = ahead[: (n - QUAD) // length * length + 1 : length] <= high
        else:
            near = (ahead[::QUAD] <= high)[: n // length * (length // QUAD)].reshape(-1, length // QUAD).all(axis=1)
        keys = np.flatnonzero(near)
        keys = keys[keys * length + low + length <= n]
        if len(keys) and self.runs:
            reach = self.reach(length)
            keys = keys[reach[keys * length] < np.minimum(keys * length + high + length, n)]
        return keys

    def reach(self, most: int) -> np.ndarray:
        """For each word the end of the furthest run that begins there or before, among those with a period of ``most`` at most."""
        ends = np.zeros(len(self.w) + 1, dtype=np.int64)
        for s, m, q in self.runs:
            if q <= most:
                ends[s] = max(ends[s], s + m)
        return np.maximum.accumulate(ends)

    def seeds(self, keys: np.ndarray, length: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, distance) of blocks and their copies."""
        import ahocorasick

        n, w = len(self.w), self.numbers
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        first: dict[tuple, int] = {}
        name = np.full(n // length + 1, -1, dtype=np.int64)
        for k in keys.tolist():
            name[k] = first.setdefault(tuple(w[k * length : (k + 1) * length]), k)
        for block, k in first.items():
            automaton.add_word(block, k)
        automaton.make_automaton()
        places, names = [], []
        begins, ends = keys * length + low, np.minimum(keys * length + high + length, n)
        cuts = np.flatnonzero(begins[1:] > ends[:-1]) + 1  # stretches in which a copy may lie
        for a, b in zip(begins[np.r_[0, cuts]].tolist(), ends[np.r_[cuts - 1, -1]].tolist(), strict=True):
            for end, k in automaton.iter(tuple(w[a:b])):
                places.append(a + end - length + 1)
                names.append(k)
        at, found = np.array(places, dtype=np.int64), np.array(names, dtype=np.int64)
        out_p, out_d = [], []
        for back in range((high - low) // length + 2):
            k = (at - low) // length - back
            some = np.flatnonzero(k >= 0)
            p = k[some] * length
            d = at[some] - p
            good = (name[k[some]] == found[some]) & (d <= high) & (d >= low)
            out_p.append(p[good])
            out_d.append(d[good])
        p, d = np.concatenate(out_p), np.concatenate(out_d)
        if self.runs and len(p):
            keep = (self.reach(length)[p] < p + d + length) & self.aligned(p, d, length)
            p, d = p[keep], d[keep]
        return p, d

    def aligned(self, p: np.ndarray, d: np.ndarray, length: int) -> np.ndarray:
        """A block inside a run of a period of half its length at most: the run around its copy must begin or end at the same distance, or touch the first one."""
        if length < 4 * QUAD or length < self.least:
            return np.ones(len(p), dtype=bool)
        starts = np.full(len(self.w), -1, dtype=np.int64)
        ends = starts.copy()
        for s, m, q in self.runs:
            if 2 * q <= length <= m:
                starts[s : s + m - length + 1] = s
                ends[s : s + m - length + 1] = s + m
        o = p + d
        return (starts[p] < 0) | (starts[o] - starts[p] == d) | (ends[o] - ends[p] == d) | (starts[o] <= ends[p])

    def extend(self, place_of: np.ndarray, distance: np.ndarray, length: int) -> None:
        n = len(self.w)
        order = np.lexsort((place_of, distance))
        last, end = 0, 0
        for p, d in zip(place_of[order].tolist(), distance[order].tolist(), strict=True):
            if d == last and p + length + d <= end:
                continue  # part of the stretch before
            right = p + _stretch(self.w, p, p + d)
            left = p - _stretch(self.back, n - p - d, n - p)
            last, end = d, right + d
            m = end - left
            if m >= max(self.least, 2 * d) and not any(np.array_equal(self.w[left : left + d], self.w[left + d // f : left + d // f + d]) for f in prime_factors(d)):
                self.runs.add((left, m, d))


def runs_of(words: list, least: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period; ``least`` is SHORTEST or more."""
    if least < SHORTEST:
        raise ValueError(f"runs of fewer than {SHORTEST} words are not looked for")
    number: dict = {}
    w = np.fromiter((number.setdefault(x, len(number)) for x in words), dtype=np.int64, count=len(words))
    return Finder(w, least).find()


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """Words without those that a run holds after its first period."""
    if not runs:
        return words
    step = np.zeros(len(words) + 1, dtype=np.int64)
    for s, m, q in runs:
        step[s + q] += 1
        step[s + m] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]


RUN = "struct<start: long, length: long, period: long>"


def periodic_runs(docs: DataFrame, text: str = "text", id_col: str = "doc_id", least: int = SHORTEST) -> DataFrame:
    """All runs of at least ``least`` words and two periods in every whole text.

    Returns, per row: the id, n_words, runs (start, length and period in words, by start and period)
    and collapsed: the words that no run holds after its first period, joined by one space.
    Words are maximal runs of characters other than space and U+0009 to U+000D. Null, empty and blank texts have
    no words and no runs. Texts of any length are worked off whole, one in one task. Null ids and repeated
    rows are rows like others; other columns are ignored, whatever their names; an empty table gives no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.free()
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            for part, texts in groups_of(batch, size=2 << 20):
                counts, found, kept = [], [], []
                for t in texts:
                    words = t.split()  # of bytes: at ASCII white space only
                    own = runs_of(words, least)
                    counts.append(len(words))
                    found.append([{"start": s, "length": m, "period": q} for s, m, q in own])
                    kept.append(b" ".join(collapsed(words, own)).decode(errors="replace"))
                yield pa.RecordBatch.from_arrays([column(part, "id"), pa.array(counts, pa.int64()), pa.array(found, kind), pa.array(kept, pa.string())], names=["id", "n_words", "runs", "collapsed"])

    worker.small_batches(docs.sparkSession)
    own, k = numbered(docs), place(docs, id_col)
    rows = own.select(F.col(k).alias("id"), F.col(place(docs, text)).alias("text"))
    return rows.mapInArrow(run, f"id {own.schema[k].dataType.simpleString()}, n_words long, runs array<{RUN}>, collapsed string").withColumnRenamed("id", id_col)


def with_planted_periods(docs: DataFrame, text: str = "text", id_col: str = "doc_id", every: int = 10, shortest: int = 3, kinds: int = 8) -> DataFrame:
    """Id and text; one text in ``every``, chosen by the id's crc32 h, is made periodic from some word on.

    With g = h / every of n words: from word a = g % n on, the words repeat those before p = 1 + (n - a) / (shortest + g % kinds) words.
    Such a text's words are joined by one space. Null ids, and texts without words, stay as they are.
    """
    own = numbered(docs)
    h = F.crc32(F.col(place(docs, id_col)).cast("string").cast("binary"))
    chosen = F.coalesce(h % every == 0, F.lit(False))
    rows = own.select(F.col(place(docs, id_col)).alias("id"), F.col(place(docs, text)).alias("text"), F.floor(h / every).alias("g"), F.when(chosen, F.array_remove(F.split(place(docs, text), r"[\x20\x09-\x0D]+"), "")).alias("words"))
    rows = rows.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (F.lit(1) + F.floor((F.col("n") - F.col("a")) / (shortest + F.col("g") % kinds))).cast("int"))
    rest = F.col("n") - F.col("a")
    unit = F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int"))
    made = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(F.flatten(unit), F.lit(1), rest)), " ")
    return rows.select(F.col("id").alias(id_col), F.when(F.col("a").isNotNull(), made).otherwise(F.col("text")).alias(text))


def digests(found: DataFrame) -> DataFrame:
    """The number of runs, the longest one (ties: the first, then that of the shortest period) and digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = found.withColumns({"best": best, "lines": F.array_join(line, "")})
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    return rows.select(
        *[c for c in found.columns if c not in ("runs", "collapsed", "n_words")],
        F.size("runs").cast("long").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
