"""Expected texts in documents whose lines were wrapped, hyphenated or spaced otherwise, found through an inverted index.

What wrapping can change is left out of the index: texts are NFKC-normalised and stripped of white space and hyphens. An item's first
characters then are its anchor, and a document that holds the item holds the anchor, wherever its lines break. Rolling
hashes of a document's characters are looked up among the anchors; what meets is verified character by character.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as Y

from ..functions import matching
from ..functions.values import normalize
from . import reservation

ANCHOR = 12  # characters; shorter items are their own anchors
SMALL = 1 << 20  # anchors' hashes that tasks can hold: 8 MB
PRIME = np.uint64(0x100000001B3)
MIXED = np.uint64(0x9E3779B97F4A7C15)


def bare(text: str) -> np.ndarray:
    """Code points of a text without white space and hyphens."""
    kept = "".join(normalize(text).split()).replace("-", "")
    return np.frombuffer(kept.encode("utf-32-le"), dtype="<u4").astype(np.uint64)


def windows(points: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` characters from each place on."""
    n = len(points) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    mixed = (points + np.uint64(1)) * MIXED
    mixed ^= mixed >> np.uint64(29)
    out = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        out = (out ^ mixed[k : k + n]) * PRIME
    return (out ^ (out >> np.uint64(32))).view(np.int64)


def anchors(items: DataFrame) -> DataFrame:
    """(item, size, h) of items (item, want) with a visible character beside hyphens and white space."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, sizes, hashes = [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                points = bare(text or "")[:ANCHOR]
                if len(points):
                    keep.append(k)
                    sizes.append(len(points))
                    hashes.append(int(windows(points, len(points))[0]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int32()), pa.array(hashes, pa.int64())], names=["item", "size", "h"])

    kind = items.schema["item"].dataType.simpleString()
    return items.select("item", "want").mapInArrow(run, f"item {kind}, size int, h long")


def candidates(docs: DataFrame, items: DataFrame, small: int = SMALL) -> DataFrame:
    """(doc, item) pairs where the document (doc, text) holds the item's anchor.

    Up to ``small`` anchors are handed to the tasks, which report what they meet; beyond that every window of the
    documents is joined with the anchors by its hash.
    """
    found = anchors(items)
    sizes = {r["size"]: r["count"] for r in found.groupBy("size").count().collect()}  # ANCHOR rows at most
    few = sum(sizes.values()) <= small
    wanted = {n: np.sort(np.array([r.h for r in found.filter(F.col("size") == n).select("h").distinct().collect()], dtype=np.int64)) for n in sizes} if few else {}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hashes = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                points = bare(text or "")
                for n in sizes:
                    own = np.unique(windows(points, n))
                    if few:
                        at = np.searchsorted(wanted[n], own)
                        own = own[(at < len(wanted[n])) & (wanted[n][np.minimum(at, len(wanted[n]) - 1)] == own)]
                    rows += [k] * len(own)
                    hashes += own.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(hashes, pa.int64())], names=["doc", "h"])

    kind = docs.schema["doc"].dataType.simpleString()
    hits = docs.select("doc", "text").mapInArrow(run, f"doc {kind}, h long")
    return hits.join(found, "h").select("doc", "item").distinct()


@F.pandas_udf(Y.ArrayType(Y.StructType([Y.StructField("low", Y.IntegerType()), Y.StructField("high", Y.IntegerType()), Y.StructField("breaks", Y.IntegerType())])))
def places_of(want: pd.Series, text: pd.Series) -> pd.Series:
    """Places of an expected text in the normalised document, and how many line breaks each has."""

    def one(w: str, t: str) -> list[dict]:
        t = normalize(t)
        return [{"low": a, "high": b, "breaks": sum(c in "\n\f" for c in t[a:b])} for a, b in matching.places(w, t)]

    return pd.Series([one(w, t) for w, t in zip(want, text, strict=True)])


def tolerant_places(docs: DataFrame, items: DataFrame, doc_id: str, doc_text: str, item_id: str, item_text: str, small: int = SMALL) -> DataFrame:
    """Every place of every item: doc_id, item_id, ink (the item's visible characters), low, high (code points of the normalised text) and breaks.

    White space may be a line break, a word may be hyphenated at one, addresses may be broken, and scripts without spaces may have some;
    numbers and words must end where the item's do. Documents are fetched again for the pairs whose anchors meet only.
    """
    own = docs.select(F.col(doc_id).alias("doc"), F.col(doc_text).alias("text")).filter("text is not null")
    wanted = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("want")).filter("want is not null")
    met = candidates(own, wanted, small).select(F.col("doc").alias("_doc"), "item")
    both = own.join(met, F.col("doc").eqNullSafe(F.col("_doc"))).join(wanted, "item")
    found = both.select("doc", "item", ink("want").alias("ink"), F.explode(places_of("want", "text")).alias("p"))
    return found.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), "ink", "p.low", "p.high", "p.breaks")


def ink(text: Column | str) -> Column:
    return F.length(F.regexp_replace(text, r"(?U)\s+", ""))


def tolerant_presence(docs: DataFrame, items: DataFrame, doc_id: str, doc_text: str, item_id: str, item_text: str, small: int = SMALL) -> DataFrame:
    """(doc, item) pairs where the document holds the item."""
    return tolerant_places(docs, items, doc_id, doc_text, item_id, item_text, small).select(doc_id, item_id).distinct()


def tolerant_coverage(docs: DataFrame, items: DataFrame, doc_id: str, doc_text: str, item_id: str, item_text: str, small: int = SMALL) -> DataFrame:
    """Which items have a place of their own in each document that holds their anchor's text: doc_id, item_id, low and high (null: none is left).

    Items with more visible characters choose first, then by their id; of an item's places that with the fewest line breaks, then the shortest, then the leftmost.
    """
    found = tolerant_places(docs, items, doc_id, doc_text, item_id, item_text, small)
    rank = [(-F.col("ink")).alias("ink"), F.col(item_id).alias("by"), F.col("breaks").alias("breaks"), (F.col("high") - F.col("low")).alias("length")]
    return reservation.exclusive_places(found, doc_id, [item_id], rank=rank)
