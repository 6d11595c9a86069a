"""Best-fit packing of tokenised documents with large-item matching.

Packing only depends on lengths, and there are at most ``capacity`` of them, so
the plan is made from their histogram whatever the number of documents: pieces
above a third of the capacity go at most two to a bin, matched greedily from the
longest on with the longest partner that fits; shorter pieces go, longest first,
to the smallest gap that holds them. The plan is a list of runs (so many pieces
of one length to consecutive bins at one offset); pieces find their run by their
rank within their length.
"""

from __future__ import annotations

import contextlib
import heapq
import os
import string
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import worker
from .columns import numbered, place
from .scratch import Scratch


@dataclass
class Plan:
    """Runs by length: pieces ranked ``rank`` and up go ``per_bin`` to each bin from ``first`` on, from offset ``base`` on."""

    capacity: int
    bins: int = 0
    runs: dict[int, list[tuple[int, int, int, int]]] = field(default_factory=dict)
    ranked: dict[int, int] = field(default_factory=dict)
    gaps: list[int] = field(default_factory=list)
    ranges: dict[int, list[tuple[int, int]]] = field(default_factory=dict)

    def put(self, length: int, pieces: int, per_bin: int, first: int, base: int) -> None:
        self.runs.setdefault(length, []).append((self.ranked.get(length, 0), per_bin, first, base))
        self.ranked[length] = self.ranked.get(length, 0) + pieces

    def leave(self, gap: int, first: int, n: int) -> None:
        """n bins from ``first`` on have room for ``gap`` more."""
        if n and gap:
            if gap not in self.ranges:
                self.ranges[gap] = []
                insort(self.gaps, gap)
            heapq.heappush(self.ranges[gap], (first, n))

    def take(self, length: int) -> tuple[int, int, int] | None:
        """The first bins of the smallest gap that holds ``length``: gap, first bin, bins."""
        k = bisect_left(self.gaps, length)
        if k == len(self.gaps):
            return None
        gap = self.gaps[k]
        first, n = heapq.heappop(self.ranges[gap])
        if not self.ranges[gap]:
            del self.ranges[gap], self.gaps[k]
        return gap, first, n

    def open(self, n: int) -> int:
        self.bins += n
        return self.bins - n


def plan_bins(histogram: dict[int, int], capacity: int) -> Plan:
    """Where the pieces go; full pieces are left out, each fills a bin of its own."""
    plan = Plan(capacity)
    left = {n: c for n, c in histogram.items() if c and n < capacity}
    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        k = bisect_left(large, capacity - n + 1) - 1  # the longest partner that fits
        if k < 0:
            first = plan.open(left[n])
            plan.put(n, left[n], 1, first, 0)
            plan.leave(capacity - n, first, left[n])
            large.pop()
            continue
        m = large[k]
        pairs = left[n] // 2 if m == n else min(left[n], left[m])
        if pairs:
            first = plan.open(pairs)
            if m == n:
                plan.put(n, 2 * pairs, 2, first, 0)
            else:
                plan.put(n, pairs, 1, first, 0)
                plan.put(m, pairs, 1, first, n)
            plan.leave(capacity - n - m, first, pairs)
            left[n] -= pairs
            left[m] -= pairs
        elif k:  # one piece is left of the length that fits itself: its partner is the next shorter one
            m = large[k - 1]
            first = plan.open(1)
            plan.put(n, 1, 1, first, 0)
            plan.put(m, 1, 1, first, n)
            plan.leave(capacity - n - m, first, 1)
            left[n] -= 1
            left[m] -= 1
        else:
            first = plan.open(1)
            plan.put(n, 1, 1, first, 0)
            plan.leave(capacity - n, first, 1)
            left[n] = 0
        large = [x for x in large if left[x]] if not (left[n] and left[m]) else large
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            found = plan.take(n)
            if found is None:
                per_bin = capacity // n
                bins = -(-left[n] // per_bin)
                found = capacity, plan.open(bins), bins
            gap, first, bins = found
            per_bin = gap // n
            full = min(bins, left[n] // per_bin)
            if full:
                plan.put(n, full * per_bin, per_bin, first, capacity - gap)
                plan.leave(gap - per_bin * n, first, full)
                left[n] -= full * per_bin
            if full < bins and left[n]:
                plan.put(n, left[n], per_bin, first + full, capacity - gap)
                plan.leave(gap - left[n] * n, first + full, 1)
                left[n], full = 0, full + 1
            plan.leave(gap, first + full, bins - full)
    return plan


def _byte_chars() -> dict[int, str]:
    """The usual printable characters for bytes: visible Latin-1 ones stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}


BYTE_CHARS = _byte_chars()


class WordCache(dict):
    """Token ids (little-endian unsigned 32-bit) of words, each worked out when it is first asked for.

    The tokenizer drops white space, so its ids of a text are those of the parts
    between spaces and line feeds, one after the other. The cache takes up about ``most``
    bytes at most; then it begins anew. The tokenizer ignores case, so a text in Latin-1,
    where that is a matter of single characters, is lower-cased first. A word of letters
    has the ids that the merges alone give, and marks at its end are tokens of their own.
    """

    def __init__(self, path: str, most: int = 48 << 20):
        from tokenizers import Tokenizer

        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.most, self.used = most, 0
        self.model = self.tokenizer.model
        self.id_bytes = [k.to_bytes(4, "little") for k in range(self.tokenizer.get_vocab_size())]
        # only if the tokenizer is of the kind for which the short ways are the same
        trial = ["word", "Words", "THE", "straße", "Über", "élan", "ÑANDÚ", "a", "internationalisation"]
        self.short = all(self._merged(w.lower()) == self._ids(w) and self._ids(f"{w}.)#") == self._ids(w) + self._ids(".)#") for w in trial)

    @staticmethod
    def of(path: str) -> WordCache:
        """This worker's cache for a tokenizer; it outlasts the task."""
        return worker.keep(f"tokens {path}", lambda: WordCache(path))

    def _ids(self, part: str) -> bytes:
        return b"".join([self.id_bytes[k] for k in self.tokenizer.encode(part, add_special_tokens=False).ids])

    def _merged(self, part: str) -> bytes:
        """Ids of a plain word in lower case from the merges alone, without the steps that find words in a text."""
        if not part.isascii():
            part = part.encode().decode("latin-1").translate(BYTE_CHARS)
        own = self.id_bytes
        return b"".join([own[t.id] for t in self.model.tokenize(part)])

    def __missing__(self, part: str) -> bytes:
        if self.used > self.most:
            self.clear()
            self.used = 0
        self.used += 230 + 6 * len(part)
        core = part.rstrip(string.punctuation) if self.short else ""
        # letters whose lower case and composition are a matter of single characters
        plain = core.isalpha() and (core.isascii() or (max(core) <= "\u024f" and "\u0130" not in core))
        if not plain:
            ids = self._ids(part)
        elif core == part:
            ids = self._merged(core.lower())
        else:
            ids = self[core] + self[part[len(core) :]]
        self[part] = ids
        return ids

    def _parts(self, text: str) -> list[str]:
        if self.short:
            with contextlib.suppress(UnicodeEncodeError):
                if text.isascii() or text.encode("latin-1"):
                    text = text.lower()
        return text.replace("\n", " ").split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        get = self.__getitem__
        return [b"".join(map(get, self._parts(t))) for t in texts]


def pieces_of(docs: DataFrame, tokenizer: Callable[[], str], capacity: int, end_id: int = 1, text: str = "text", id_col: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 and, with ``keep_ids``, the ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCache.of(tokenizer())
        end = np.asarray([end_id], dtype="<u4").tobytes()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and size < 2_000_000:
                    size += len(texts[stop])
                    stop += 1
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for k, own in enumerate(cache.encode(texts[at:stop])):
                    own += end
                    for p, low in enumerate(range(0, len(own), 4 * capacity)):
                        part = own[low : low + 4 * capacity]
                        row.append(at + k)
                        piece.append(p)
                        start.append(low // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if keep_ids:
                            ids.append(np.frombuffer(part, dtype="<u4").astype(np.int32))
                cols = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)
                at = stop

    worker.small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    rows = numbered(docs).select(F.col(place(docs, id_col)).alias("id"), F.col(place(docs, text)).alias("text"))
    return rows.mapInArrow(run, schema)


def pack(pieces: DataFrame, capacity: int = 4096, blocks: int = 256) -> DataFrame:
    """Adds sequence_id and offset to pieces with a length of 1 to ``capacity``."""
    scratch = Scratch(pieces.sparkSession, "packing")
    pieces = scratch.save(pieces.withColumn("row", F.monotonically_increasing_id()))
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # one entry a length
    plan = plan_bins(histogram, capacity)
    runs = {n: tuple(np.array(x, dtype=np.int64) for x in zip(*rows, strict=True)) for n, rows in plan.runs.items()}
    names = [c for c in pieces.columns if c != "row"]

    # full pieces need no rank: each is a sequence of its own, numbered after the planned ones
    full = pieces.filter(F.col("length") == capacity).select(*names, (F.col("row") + plan.bins).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.filter(F.col("length") < capacity).withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = rest.groupBy("length", "block").agg(F.count("*").alias("n"))
    offsets = counts.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))  # a window has one row a block
    nth = F.row_number().over(Window.partitionBy("length", "block").orderBy("row")) - 1
    ranked = rest.withColumn("nth", nth).join(offsets, ["length", "block"]).select(*names, (F.col("nth") + F.col("shift")).alias("rank"))

    def place(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            length, rank = frame["length"].to_numpy(), frame["rank"].to_numpy()
            bins, offsets = np.zeros(len(frame), dtype=np.int64), np.zeros(len(frame), dtype=np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                n = int(length[own[0]])
                starts, per_bin, first, base = runs[n]
                k = np.searchsorted(starts, rank[own], side="right") - 1
                inside = rank[own] - starts[k]
                bins[own] = first[k] + inside // per_bin[k]
                offsets[own] = base[k] + inside % per_bin[k] * n
            yield frame[names].assign(sequence_id=bins, offset=offsets)

    return full.unionByName(ranked.mapInPandas(place, full.schema))


def pack_documents(docs: DataFrame, tokenizer: Callable[[], str], capacity: int = 4096, text: str = "text", id_col: str = "doc_id", end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """Packs all documents into sequences of at most ``capacity`` tokens.

    ``tokenizer`` returns the tokenizer file's path and is called on executors. A
    document is its ids, then ``end_id``; only longer ones are cut. Returns one row
    per piece: the id, piece, start, length, ids_crc32, sequence_id, offset. Null
    and empty texts are the end id alone; texts of any length are tokenised whole and
    cut into pieces. Null ids and repeated rows are packed like all others, each on its
    own; which of equally long pieces goes where follows the order in which rows are
    read. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    out = pack(pieces_of(docs, tokenizer, capacity, end_id, text, id_col, keep_ids), capacity)
    return out.withColumnRenamed("id", id_col)
