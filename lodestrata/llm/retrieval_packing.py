"""Packing of lexically related documents into windows, by retrieval from a sharded BM25 index.

Documents are tokenised once; token ids are the index's terms, and document frequencies and
lengths are those of all documents. What a document has in whole windows stays by itself; its last part, and
every shorter document, is an item to be packed. Items are dealt to shards of bounded weight by a
sign sketch of their BM25 vectors, so that related items meet, and one task holds one shard at a time. There
an inverted index gives each seed its neighbours by score: those not used yet are put into
the seed's window, best first, if they fit whole; the best of the others is cut to fill what is left, and its rest is
the next seed. What remains at a shard's end is cut into sequences of powers of two, which need no padding.
"""

from __future__ import annotations

import contextlib
import itertools
import os
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import worker
from .columns import numbered, place
from .hashing import column, mix, slices
from .packing import BYTE_CHARS
from .scratch import Scratch
from .spans import runs

K1, B = 1.2, 0.75
BITS = 16  # of a sketch: so many buckets, and no more, are counted on the driver
DOCS, TOKENS = -1, -2  # rows beside the terms' counts


# How a byte-level tokenizer finds words; and the same for texts without two white-space characters in a row.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
TRIAL = ["Two words", "a,b c.\nd straße 12\n\ne  f \tg", " x\n", "won't 3rd\r\nÜber élan... (x) ", "\n\n\na b  ", "internationalisation ①² 日本語", ""]


class ByteTokens:
    """Token ids of texts by a tokenizer's file.

    If a trial shows that the file is a byte-level one with its merges in the order of its ids, a second library works
    the same ids out, several times as fast. Texts that hold a special token's string go to the first. No token reaches from
    another character to a white space after it, so of many texts each different word with its space before it is worked out once.
    """

    GAP = re.compile(r"\s\s")

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        byte = {c: b for b, c in BYTE_CHARS.items()}
        vocabulary = {t: k for t, k in self.tokenizer.get_vocab().items() if t not in self.special}
        self.fast = None
        if all(c in byte for t in vocabulary for c in t):
            ranks = {bytes(byte[c] for c in t): k for t, k in vocabulary.items()}
            with contextlib.suppress(Exception):  # a vocabulary of another kind
                self.fast = [tiktoken.Encoding(name, pat_str=words, mergeable_ranks=ranks, special_tokens={}) for name, words in (("words", WORDS), ("plain", PLAIN_WORDS))]
            self.spaced = np.zeros(self.size, dtype=bool)  # the ids of tokens that begin with a space
            self.spaced[[k for t, k in ranks.items() if t[:1] == b" "]] = True
        if self.fast and not [self.ids(t) for t in TRIAL] == [x.tolist() for x in self.arrays(pa.array(TRIAL))] == [self._slow(t) for t in TRIAL]:
            self.fast = None

    @staticmethod
    def of(path: str) -> ByteTokens:
        """This worker's tokenizer; it outlasts the task."""
        return worker.keep(f"byte tokens {path}", lambda: ByteTokens(path))

    def _slow(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _fast(self, text: str) -> list[int]:
        return self.fast[0 if self.GAP.search(text) else 1].encode_ordinary(text)

    def ids(self, text: str) -> list[int]:
        if not self.fast or any(s in text for s in self.special):
            return self._slow(text)
        return self._fast(text)

    def arrays(self, texts: pa.Array, end: tuple[int, ...] = ()) -> list[np.ndarray]:
        """The ids of each text, and those of ``end`` after them."""
        texts = pc.fill_null(texts, "")
        if not self.fast or not len(texts):
            return [np.array([*self.ids(t), *end], dtype="<u4") for t in texts.to_pylist()]
        split = pc.split_pattern(texts, " ")
        edges = split.offsets.to_numpy()
        firsts, lasts = edges[:-1], edges[1:] - 1
        flat = split.flatten()
        coded = flat.dictionary_encode()
        word, words = coded.indices.to_numpy(), coded.dictionary
        size = pc.binary_length(words).to_numpy(zero_copy_only=False)
        trailing = pc.binary_length(pc.utf8_rtrim_whitespace(words)).to_numpy(zero_copy_only=False) < size
        joint = ~trailing & (size > 0)  # a cut after these words is one between tokens

        # texts with a cut of another kind are worked out by themselves
        apart = np.zeros(len(texts), dtype=bool)
        for x in self.special:
            apart |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        loose = ~joint[word]
        loose[firsts] = trailing[word[firsts]]
        loose[lasts] = False
        apart |= np.logical_or.reduceat(loose, firsts)

        known = pa.ListArray.from_arrays(pa.array([0, int(joint.sum())], pa.int32()), words.filter(pa.array(joint)))
        together = pc.binary_join(known, pa.scalar(" ", words.type))[0].as_py()
        ids = self._fast(f" {together}") if together else []
        ids = np.fromiter(ids, dtype="<u4", count=len(ids))

        # what stands for itself: the first words, last words that no cut follows, nothing, and the end
        own = [self.ids(text.as_py() if alone else first) for alone, text, first in zip(apart.tolist(), texts, flat.take(pa.array(firsts)).to_pylist(), strict=True)]
        ending = lasts[~joint[word[lasts]] & (lasts > firsts)]
        own += [self.ids(f" {t}") for t in flat.take(pa.array(ending)).to_pylist()]
        own += [[], [*end]]
        counts = np.array([len(x) for x in own])
        begins = np.concatenate([np.flatnonzero(self.spaced[ids]), len(ids) + np.cumsum(counts) - counts])
        counts = np.diff(begins, append=len(ids) + int(counts.sum()))
        ids = np.concatenate([ids, np.fromiter(itertools.chain.from_iterable(own), dtype="<u4")])

        at = (np.cumsum(joint) - 1)[word]
        at[ending] = len(begins) - 2 - len(ending) + np.arange(len(ending))
        at[np.repeat(apart, np.diff(edges))] = len(begins) - 2
        at[firsts] = int(joint.sum()) + np.arange(len(firsts))
        at = np.insert(at, edges[1:], len(begins) - 1)
        sizes = counts[at]
        stops = np.cumsum(sizes)
        kind = np.int32 if stops[-1] < 1 << 31 else np.int64
        places = np.arange(stops[-1], dtype=kind)
        places += np.repeat((begins[at] - stops + sizes).astype(kind), sizes)
        out = ids[places]
        return np.split(out, stops[edges[1:-1] + np.arange(len(texts) - 1)])


def narrow(ids: np.ndarray, size: int) -> bytes:
    """Ids in two bytes each, if the vocabulary allows."""
    return ids.astype("<u2" if size <= 1 << 16 else "<u4").tobytes()


def wide(raw: bytes, count: int) -> np.ndarray:
    return np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * count else "<u4")


def split_documents(docs: DataFrame, tokenizer: Callable[[], str], capacity: int, end_id: int, text: str, id_col: str) -> DataFrame:
    """Whole windows (start, length, ids_crc32), and items: a document's last tokens (ids) with the whole document's terms and their counts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = ByteTokens.of(tokenizer())
        for batch in batches:
            for part in slices(batch):
                rows: list[tuple] = []
                for k, own in enumerate(tokens.arrays(part.column(1), (end_id,))):
                    n = len(own)
                    tail = n - n % capacity
                    rows += [(k, low, capacity, zlib.crc32(own[low : low + capacity]), n, None, None, None) for low in range(0, tail, capacity)]
                    if tail < n:
                        terms, counts = np.unique(own[:-1], return_counts=True)
                        rows.append((k, tail, n - tail, None, n, narrow(own[tail:], tokens.size), narrow(terms, tokens.size), np.minimum(counts, 65535).astype("<u2").tobytes()))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, kind) for c, kind in zip(cols[1:], kinds, strict=True))], names=["id", "start", "length", "ids_crc32", "doc_tokens", "ids", "terms", "counts"])

    worker.small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = numbered(docs).select(F.col(place(docs, id_col)).alias("id"), F.col(place(docs, text)).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, ids binary, terms binary, counts binary")


class Statistics:
    """How many documents hold each term, and how long documents are: over all documents, as large as the vocabulary."""

    def __init__(self, counts: dict[int, int]):
        docs = counts.pop(DOCS, 0)
        self.average = counts.pop(TOKENS, 0) / max(1, docs)
        often = np.zeros(max(counts, default=0) + 1)
        often[list(counts)] = list(counts.values())
        # what more than half of the documents have tells nothing
        self.idf = np.where(often > 0, np.maximum(0.0, np.log(np.maximum(docs - often + 0.5, 0.5) / (often + 0.5))), 0.0).astype(np.float32)

    def weights(self, terms: np.ndarray, counts: np.ndarray, doc_tokens: np.ndarray) -> np.ndarray:
        """BM25 weights of postings."""
        return self.idf[terms] * counts * (K1 + 1) / (counts + K1 * (1 - B + B * doc_tokens / self.average))


def postings(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, term, count) of a batch's items, one after the other."""
    counted = [np.frombuffer(c, dtype="<u2") for c in batch.column("counts").to_pylist()]
    terms = [wide(t, len(c)) for t, c in zip(batch.column("terms").to_pylist(), counted, strict=True)]
    item = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
    none = np.zeros(0, dtype="<u2")
    return item, np.concatenate([*terms, none]), np.concatenate([*counted, none])


def statistics(items: DataFrame) -> Statistics:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.free()
        often, docs, tokens = np.zeros(0, dtype=np.int64), 0, 0
        for batch in batches:
            _, terms, _ = postings(batch)
            own = np.bincount(terms, minlength=len(often))
            own[: len(often)] += often
            often = own
            docs += batch.num_rows
            tokens += int(column(batch, "doc_tokens").to_numpy().sum())
        some = np.flatnonzero(often)
        yield pa.RecordBatch.from_arrays([pa.array([*some.tolist(), DOCS, TOKENS], pa.int64()), pa.array([*often[some].tolist(), docs, tokens], pa.int64())], names=["term", "n"])

    found = items.select("terms", "counts", "doc_tokens").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return Statistics({r.term: r.n for r in found.collect()})  # a row a term of the vocabulary


def sketches(batch: pa.RecordBatch, stats: Statistics) -> np.ndarray:
    """The signs of BITS random sums of each item's BM25 vector, as a number."""
    item, terms, counts = postings(batch)
    n = batch.num_rows
    w = stats.weights(terms, counts.astype(np.float32), column(batch, "doc_tokens").to_numpy()[item])
    item, terms, w = item[w > 0], terms[w > 0], w[w > 0]
    bits = mix(terms.astype(np.uint64), 3)
    out = np.zeros(n, dtype=np.int64)
    for k in range(BITS):
        signs = ((bits >> np.uint64(k)) & np.uint64(1)).astype(np.float32) * 2 - 1
        out = out * 2 + (np.bincount(item, w * signs, n) > 0)
    return out


def weights_of(batch: pa.RecordBatch) -> np.ndarray:
    """What an item weighs in a shard: its tokens and its terms."""
    terms = np.array([len(c) // 2 for c in column(batch, "counts").to_pylist()], dtype=np.int64)
    return column(batch, "length").to_numpy() + terms


def deal(weights: dict[int, int], most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket its first shard and how many it has: neighbours share one, a heavy bucket has several."""
    first, parts = np.zeros(1 << BITS, dtype=np.int64), np.ones(1 << BITS, dtype=np.int64)
    shard = held = 0
    for bucket in sorted(weights):
        w = weights[bucket]
        if held and held + w > most:
            shard, held = shard + 1, 0
        first[bucket] = shard
        parts[bucket] = max(1, -(-w // most))
        held += w
        if parts[bucket] > 1:
            shard, held = shard + int(parts[bucket]), 0
    return first, parts


class Shard:
    """An inverted index over a shard's items, and their packing."""

    def __init__(self, table: pa.Table, stats: Statistics):
        item, terms, counts = postings(table)
        self.n = table.num_rows
        self.length = table.column("length").to_numpy().astype(np.int64)
        w = stats.weights(terms, counts.astype(np.float32), table.column("doc_tokens").to_numpy()[item])
        item, terms, w = item[w > 0], terms[w > 0], w[w > 0]
        self.terms = np.split(terms, np.searchsorted(item, np.arange(1, self.n)))
        # terms of an eighth of the items have a row for all items, the others a list
        often = np.bincount(terms, minlength=len(stats.idf))
        common = np.flatnonzero(8 * often >= max(1, self.n))
        self.row = np.full(len(often), -1)
        self.row[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), self.n))
        row = self.row[terms]
        self.rows[row[row >= 0], item[row >= 0]] = w[row >= 0]
        item, terms, w = item[row < 0], terms[row < 0], w[row < 0]
        order = np.argsort(terms, kind="stable")
        self.items, self.weights = item[order], w[order]
        self.begins = np.searchsorted(terms[order], np.arange(len(stats.idf) + 1))

    def scores(self, query: int) -> np.ndarray:
        """BM25 of all items for the terms of one."""
        row = self.row[self.terms[query]]
        own = self.terms[query][row < 0].astype(np.int64)
        begins = self.begins[own]
        sizes = self.begins[own + 1] - begins
        at = np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        return np.bincount(self.items[at], self.weights[at], self.n) + self.rows[row[row >= 0]].sum(axis=0)

    def windows(self, capacity: int) -> Iterator[list[tuple[int, int, int]]]:
        """Sequences as (item, from, to)."""
        left = self.length.copy()
        given = np.zeros(self.n, dtype=np.int64)
        seed = following = 0
        while True:
            while following < self.n and not left[following]:
                following += 1
            if seed is None or not left[seed]:
                if following == self.n:
                    return
                seed = following
            window: list[tuple[int, int, int]] = []
            room = capacity

            def take(item: int, tokens: int) -> None:
                window.append((item, int(given[item]), int(given[item]) + tokens))
                given[item] += tokens
                left[item] -= tokens

            take(seed, own := min(room, int(left[seed])))
            room -= own
            cut = None
            if room:
                score = self.scores(seed)
                free = np.flatnonzero(left)
                # unrelated items come last, in their order
                ranked = free[np.argsort(-score[free], kind="stable")]
                tokens = left[ranked]
                at = 0
                while room and at < len(ranked):
                    fits = tokens[at:] <= room
                    first = int(fits.argmax())
                    if cut is None and not fits[0]:
                        cut = int(ranked[at])
                    if not fits[first]:
                        break
                    at += first
                    take(int(ranked[at]), int(tokens[at]))
                    room -= int(tokens[at])
                    at += 1
                if room and cut is not None:
                    take(cut, room)
                    room = 0
            seed = cut
            if not room:
                yield window
            else:  # nothing is left
                yield from in_powers_of_two(window)
                return


def in_powers_of_two(window: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """A window's tokens as sequences whose lengths are powers of two, the longest first."""
    total = sum(b - a for _, a, b in window)
    rest = window[::-1]
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        out = []
        while room:
            item, a, b = rest.pop()
            if b - a > room:
                rest.append((item, a + room, b))
                b = a + room
            out.append((item, a, b))
            room -= b - a
        yield out


def pack_by_retrieval(docs: DataFrame, tokenizer: Callable[[], str], capacity: int = 1024, text: str = "text", id_col: str = "doc_id", end_id: int = 0, shard_weight: int = 400_000, keep_ids: bool = False) -> DataFrame:
    """Packs all documents into sequences of ``capacity`` tokens, each with its lexical neighbours.

    ``tokenizer`` returns the tokenizer file's path and is called on executors. A document is its ids, then
    ``end_id``. Returns one row per piece: the id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset and, with ``keep_ids``, ids of what isn't a whole window (null for those). Every id lies in one piece; sequences are full, but for those
    whose length is a power of two. Null and empty texts are the end id alone; texts of any length are tokenised and indexed
    whole. Null ids and repeated rows are packed like all others, each on its own; copies are each other's nearest neighbours. Ties
    go by the order in which rows are read. Other columns are ignored, whatever their names; an empty table gives no rows.

    A shard weighs about ``shard_weight`` (tokens and terms), which bounds a task's memory; neighbours are those in the seed's shard.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "retrieval")
    pieces = scratch.save(split_documents(docs, tokenizer, capacity, end_id, text, id_col).withColumn("row", F.monotonically_increasing_id()))
    items = pieces.filter("ids is not null").drop("ids_crc32")
    stats = statistics(items)

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.free()
        total = np.zeros(1 << BITS, dtype=np.int64)
        for batch in batches:
            np.add.at(total, sketches(batch, stats), weights_of(batch))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "weight"])

    weighed = items.select("length", "doc_tokens", "terms", "counts").mapInArrow(weigh, "bucket long, weight long").groupBy("bucket").agg(F.sum("weight").alias("weight"))
    first, parts = deal({r.bucket: r.weight for r in weighed.collect()}, shard_weight)  # 2 ** BITS rows at most

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.free()
        for batch in batches:
            bucket = sketches(batch, stats)
            row = mix(column(batch, "row").to_numpy().astype(np.uint64), 9)
            shard = first[bucket] + (row % parts[bucket].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard)], names=[*batch.schema.names, "shard"])

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.free()
        for table in runs(batches, ["shard"]):
            shards = table.column("shard").to_numpy()
            cuts = np.flatnonzero(shards[1:] != shards[:-1]) + 1
            for a, b in zip([0, *cuts], [*cuts, len(shards)], strict=True):
                yield packed(table.slice(a, b - a), int(shards[a]))

    def packed(table: pa.Table, shard: int) -> pa.RecordBatch:
        lengths, starts = table.column("length").to_pylist(), table.column("start").to_numpy()
        ids = [wide(raw, n).astype("<u4") for raw, n in zip(table.column("ids").to_pylist(), lengths, strict=True)]
        rows = []
        for k, window in enumerate(Shard(table, stats).windows(capacity)):
            offset = 0
            for item, a, b in window:
                rows.append((item, a, b - a, zlib.crc32(ids[item][a:b].tobytes()), 2 * (shard << 21 | k) + 1, offset))
                offset += b - a
        item, low, length, crc, sequence, offset = (np.array(c, dtype=np.int64) for c in zip(*rows, strict=True))
        at = pa.array(item)
        whole = table.select(["id", "doc_tokens"]).combine_chunks().take(at)
        cols = [whole.column("id").combine_chunks(), pa.array(starts[item] + low), pa.array(length), pa.array(crc), whole.column("doc_tokens").combine_chunks(), pa.array(sequence), pa.array(offset)]
        if keep_ids:
            cols.append(pa.array([ids[r[0]][r[1] : r[1] + r[2]].astype(np.int32) for r in rows], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(cols, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * keep_ids
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * keep_ids
    dealt = items.mapInArrow(assign, f"id {kind}, start long, length long, doc_tokens long, ids binary, terms binary, counts binary, row long, shard long")
    found = dealt.repartition("shard").sortWithinPartitions("shard", "row").mapInArrow(pack, schema)
    whole = pieces.filter("ids is null").select("id", "start", "length", "ids_crc32", "doc_tokens", (2 * F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return whole.unionByName(found, allowMissingColumns=True).withColumnRenamed("id", id_col)
