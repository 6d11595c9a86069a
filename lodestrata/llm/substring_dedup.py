"""Substring deduplication with difference-cover anchors.

Two equal windows of W words at any positions i and j share an offset k below
the period V at which i + k and j + k are both cover positions (0, 1, 4, 14, 16
modulo 21 is a perfect difference set). So only the anchors - A = W - V + 1
words from each cover position on - are hashed for the whole corpus. Positions
whose anchor occurs twice are the only ones near which a window can repeat;
there the match is extended: the full windows are hashed in two independent families,
128 bits, counted, and the words of the repeated ones go. Words collide by chance
only (see ``hashing``): 10**12 windows make one false repeat with probability 10**-15.

Rows are matched by their text's fingerprint, not by id, so null or repeated ids
are no trouble. A text that occurs twice repeats as a whole; one of its copies
is enough to tell the other texts about it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import worker
from .columns import fingerprint, numbered, place
from .hashing import column, groups_of, hash_words, signed, window_hashes, word_bounds, word_hashes
from .scratch import Scratch

COVER, PERIOD = (0, 1, 4, 14, 16), 21
KEY = ["fa", "fb"]


def _inside(counts: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For all windows of the joined words: number in the document, words left from there on."""
    at = np.arange(int(counts.sum())) - np.repeat(starts, counts)
    return at, np.repeat(counts, counts) - at


def _anchors(window: int):
    width = window - PERIOD + 1
    cover = np.zeros(PERIOD, dtype=bool)
    cover[list(COVER)] = True

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.free()
        for batch in batches:
            for part, texts in groups_of(batch):
                words, off = hash_words(texts)
                counts = np.diff(off)
                h = window_hashes(words, width)
                at, left = _inside(counts, off[:-1], width)
                # a document shorter than a window has none
                pick = np.flatnonzero(cover[at[: len(h)] % PERIOD] & (left[: len(h)] >= width) & (np.repeat(counts, counts)[: len(h)] >= window))
                doc = np.repeat(np.arange(len(texts)), counts)[pick]
                fa, fb = (column(part, k).to_numpy()[doc] for k in KEY)
                yield pa.RecordBatch.from_arrays([pa.array(signed(h[pick])), pa.array(fa), pa.array(fb), pa.array(at[pick].astype(np.int32))], names=["h", "fa", "fb", "pos"])

    return run


def _windows(window: int):
    """128-bit hashes of the windows that contain a repeated anchor."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.free()
        for batch in batches:
            for part, texts in groups_of(batch):
                (words, others), off = word_hashes(texts, 2)
                counts = np.diff(off)
                ha, hb = window_hashes(words, window), window_hashes(others, window)
                marks = np.zeros(len(words) + 1, dtype=np.int32)
                for k, pos in enumerate(column(part, "anchors")):
                    # the windows from p - PERIOD + 1 to p begin close enough to an anchor at p
                    p = np.asarray(pos.as_py(), dtype=np.int64)
                    np.add.at(marks, off[k] + np.maximum(p - PERIOD + 1, 0), 1)
                    np.add.at(marks, off[k] + p + 1, -1)
                at, left = _inside(counts, off[:-1], window)
                pick = np.flatnonzero((np.cumsum(marks)[: len(ha)] > 0) & (left[: len(ha)] >= window))
                doc = np.repeat(np.arange(len(texts)), counts)[pick]
                cols = [pa.array(signed(ha[pick])), pa.array(signed(hb[pick])), *(pa.array(column(part, k).to_numpy()[doc]) for k in KEY), pa.array(at[pick].astype(np.int32)), pa.array(column(part, "copied").to_numpy(zero_copy_only=False)[doc])]
                yield pa.RecordBatch.from_arrays(cols, names=["ha", "hb", *KEY, "pos", "copied"])

    return run


def _cut(window: int, names: list[str], texts_out: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.free()
        for batch in batches:
            for part, texts in groups_of(batch):
                starts_col, copied = column(part, "starts"), column(part, "copied").to_pylist()
                n, removed, kept = [], [], []
                for k, t in enumerate(texts):
                    words = np.stack(word_bounds(np.frombuffer(t, dtype=np.uint8)), 1)
                    gone = np.zeros(len(words) + 1, dtype=np.int32)
                    if copied[k] and len(words) >= window:
                        gone[0] = 1
                    elif starts_col[k].is_valid:
                        p = np.unique(starts_col[k].values.to_numpy().astype(np.int64))
                        gone[p] += 1
                        np.add.at(gone, p + window, -1)
                    stay = words[np.cumsum(gone)[:-1] == 0]
                    n.append(len(words))
                    removed.append(len(words) - len(stay))
                    kept.append(b" ".join([t[a:b] for a, b in stay.tolist()]))
                cols = [column(part, c) for c in names] + [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
                if texts_out:
                    cols.append(pa.array([x.decode() for x in kept], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=[*names, "n_words", "n_removed", "kept_sha256", *["kept"] * texts_out])

    return run


def substring_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id", window: int = 35, keep_text: bool = False) -> DataFrame:
    """Removes every word covered by a window of ``window`` words that also starts elsewhere in ``docs``.

    Returns one row per row of ``docs``: the id, n_words, n_removed, kept_sha256
    and, with ``keep_text``, the kept words joined by one space as ``kept``.
    Null texts count as empty; texts shorter than a window lose nothing; repeated
    rows are documents of their own, so long ones lose every word, as does every one
    of several equal texts. A text of any length is worked off whole, by itself if
    it is long. Other columns of ``docs`` are ignored, whatever their names. An
    empty table gives no rows.
    """
    if window < PERIOD + 4:
        raise ValueError(f"a window must have {PERIOD + 4} words at least")
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    fa, fb = fingerprint(F.coalesce(F.col(place(docs, text)), F.lit("")))
    base = numbered(docs).select(F.col(place(docs, id_col)).alias("id"), F.col(place(docs, text)).alias("text"), fa.alias("fa"), fb.alias("fb"))

    anchors = base.select("text", *KEY).mapInArrow(_anchors(window), "h long, fa long, fb long, pos int")
    repeated = scratch.save(anchors.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"))
    near = anchors.join(repeated, "h", "left_semi").groupBy(*KEY).agg(F.collect_set("pos").alias("anchors"))
    copies = base.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("id").alias("first")).filter("n > 1")
    info = scratch.save(near.join(copies, KEY, "full"))
    scratch.drop(repeated)

    speaks = F.col("n").isNull() | F.col("id").eqNullSafe(F.col("first"))
    told = base.join(info.filter("anchors is not null"), KEY).filter(speaks).select("text", *KEY, "anchors", F.col("n").isNotNull().alias("copied"))
    windows = scratch.save(told.mapInArrow(_windows(window), "ha long, hb long, fa long, fb long, pos int, copied boolean"))
    twice = scratch.save(windows.groupBy("ha", "hb").agg(F.count("*").alias("n")).filter("n > 1").select("ha", "hb"))
    starts = windows.filter("not copied").join(twice, ["ha", "hb"], "left_semi").groupBy(*KEY).agg(F.collect_set("pos").alias("starts"))
    marks = scratch.save(starts.join(info.filter("n is not null").select(*KEY, F.lit(True).alias("copied")), KEY, "full"))
    scratch.drop(info, windows, twice)

    kind = docs.schema[id_col].dataType.simpleString()
    out = base.join(marks, KEY, "left").select("id", "text", "starts", F.coalesce("copied", F.lit(False)).alias("copied"))
    schema = f"id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text
    return out.mapInArrow(_cut(window, ["id"], keep_text), schema).withColumnRenamed("id", id_col)


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), h AS (
  SELECT r, p, md5(array_to_string(w[p:p + 34], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35)
), gone AS (
  SELECT DISTINCT r, unnest(range(p, p + 35)) AS k FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)
), removed AS (
  SELECT r, count(*) AS n_removed FROM gone GROUP BY r
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY k) AS t FROM (SELECT r, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word FROM d) ANTI JOIN gone USING (r, k) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN removed USING (r) LEFT JOIN kept USING (r)
"""
