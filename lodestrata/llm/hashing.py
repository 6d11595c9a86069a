"""Vectorised hashes of words and word windows.

A word is a maximal run of bytes other than space and 0x09-0x0D. Its hash is the
sum of random 64-bit numbers, one for each (place in the word, byte), so no two
words collide by their structure, only by chance. A window's hash joins the hashes
of its words pair by pair, each time through a bit mixer. Families are independent
from the bytes on: equal values in two families are 128 bits of evidence. Equal
words and windows always get equal hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

U = np.uint64
CHUNK = 1 << 20
PLACES = 64  # places in a word whose numbers are kept in a table


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x + U((0x9E3779B97F4A7C15 * (2 * salt + 1)) & (2**64 - 1))
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _numbers(codes: np.ndarray, family: int) -> np.ndarray:
    """The random number of place * 256 + byte."""
    return mix(mix(codes.astype(U), 11 + family) ^ U(0xD6E8FEB86659FD93), 5 + family)


@cache
def _table(family: int) -> np.ndarray:
    return _numbers(np.arange(PLACES * 256), family)


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte array."""
    inside = np.zeros(len(buf) + 2, dtype=np.int8)
    inside[1:-1] = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _pieces(texts: list[bytes]) -> Iterator[list[tuple[int, bytes]]]:
    """(text number, bytes) in groups of about CHUNK bytes; long texts are cut between words only."""
    group: list[tuple[int, bytes]] = []
    size = 0
    for k, t in enumerate(texts):
        at = 0
        while True:
            end = len(t)
            if end - at > 2 * CHUNK:
                end = at + CHUNK
                while end < len(t) and not (t[end] == 32 or 9 <= t[end] <= 13):
                    end += 1
            group.append((k, t[at:end]))
            size += end - at
            if size >= CHUNK:
                yield group
                group, size = [], 0
            at = end
            if at >= len(t):
                break
    if group:
        yield group


def word_hashes(texts: list[bytes], families: int = 1) -> tuple[list[np.ndarray], np.ndarray]:
    """For each family the hashes of all words, one text after the other; where each text's words begin (one more entry than texts)."""
    hashes: list[list[np.ndarray]] = [[] for _ in range(families)]
    counts = np.zeros(len(texts), dtype=np.int64)
    for group in _pieces(texts):
        buf = np.frombuffer(b" ".join(p for _, p in group), dtype=np.uint8)
        starts, ends = word_bounds(buf)
        edges = np.cumsum([0] + [len(p) + 1 for _, p in group])
        np.add.at(counts, [k for k, _ in group], np.diff(np.searchsorted(starts, edges)))
        if not len(starts):
            continue
        lengths = ends - starts
        firsts = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum())) - np.repeat(firsts, lengths)
        codes = place * 256 + buf[place + np.repeat(starts, lengths)]
        long = np.flatnonzero(place >= PLACES)
        for family, out in enumerate(hashes):
            values = _table(family).take(codes, mode="clip")
            if len(long):
                values[long] = _numbers(codes[long], family)
            out.append(mix(np.add.reduceat(values, firsts), family))
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(counts, out=offsets[1:])
    return [np.concatenate(h) if h else np.zeros(0, dtype=U) for h in hashes], offsets


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The first family of ``word_hashes``."""
    hashes, offsets = word_hashes(texts)
    return hashes[0], offsets


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * U(0xD1342543DE82EF95) + (right ^ (right >> U(32))) * U(0xA0761D6478BD642F))


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; windows over a text's end are the caller's to leave out."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=U)
    run, size, out, done = words, 1, None, 0
    while True:  # runs of 1, 2, 4, ... words; those in n's binary digits make up the window
        if n & size:
            part = run[done : done + m]
            out = part if out is None else _joined(out, part)
            done += size
        if done == n:
            return mix(out, 1)
        run = _joined(run[:-size], run[size:])
        size *= 2


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def slices(batch: pa.RecordBatch, column: str = "text", size: int = 4 * CHUNK) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``size`` bytes of text, so that memory stays bounded by the longest text."""
    at = batch.schema.get_field_index(column)
    lengths = np.asarray(pa.compute.binary_length(batch.column(at)).fill_null(0), dtype=np.int64)
    total = np.cumsum(lengths)
    first = 0
    while first < batch.num_rows:
        before = total[first - 1] if first else 0
        stop = min(batch.num_rows, int(np.searchsorted(total, before + size)) + 1)
        yield batch.slice(first, stop - first)
        first = stop


def groups_of(batch: pa.RecordBatch, column: str = "text", size: int = 4 * CHUNK) -> Iterable[tuple[pa.RecordBatch, list[bytes]]]:
    """``slices`` with the bytes of their texts."""
    for part in slices(batch, column, size):
        yield part, text_bytes(part.column(part.schema.get_field_index(column)))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
