"""Which expected texts a document has, as runs of white-space tokens, and where."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T

ANCHOR = 6
SMALL_BYTES = 16 << 20


def token_places(docs: DataFrame, items: DataFrame, doc_id: str, doc_text: str, item_id: str, item_text: str, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """Every place of every item in a document: doc_id, item_id, at (token, from 0) and n (tokens).

    An item's first tokens are its anchor; anchors have ANCHOR tokens, items of fewer tokens their own length. Where the anchors' first
    tokens take ``small_bytes`` at most they are broadcast, and a document's tokens are hashed only from such a token on; else all its
    runs of as many tokens are. Only hashes, ids and places are joined; the documents that an anchor meets
    are fetched again by their id and verified on the whole item.
    """
    items = items.select(F.col(item_id).alias("item"), F.split(T.collapse(item_text), " ").alias("want")).filter("want[0] <> ''")
    items = items.withColumn("size", F.least(F.size("want"), F.lit(ANCHOR)))
    anchors = items.select("item", "size", F.xxhash64("size", F.slice("want", F.lit(1), F.col("size"))).alias("h"))
    firsts = items.select(F.get("want", F.lit(0)).alias("tok"), "size").distinct()
    docs = docs.select(F.col(doc_id).alias("doc"), F.split(T.collapse(doc_text), " ").alias("have"))
    run = lambda at, size: F.xxhash64(size, F.slice("have", at + 1, size))
    small = firsts.agg(F.coalesce(F.sum(F.octet_length("tok") + 16), F.lit(0))).first()[0] <= small_bytes
    if small:
        met = docs.select("doc", "have", F.posexplode_outer("have").alias("at", "tok")).join(F.broadcast(firsts), "tok")
        found = met.filter(F.col("at") + F.col("size") <= F.size("have")).select("doc", "at", run(F.col("at"), F.col("size")).alias("h"))
    else:
        sizes = F.array(*[F.lit(k + 1) for k in range(ANCHOR)])
        wide = docs.select("doc", "have", F.explode(sizes).alias("size")).filter("size(have) >= size")
        found = wide.select("doc", "have", "size", F.explode_outer(F.sequence(F.lit(0), F.size("have") - F.col("size"))).alias("at")).select("doc", "at", run(F.col("at"), F.col("size")).alias("h"))
    hits = found.join(anchors.select("item", "h"), "h").select(F.col("doc").alias("_doc"), "at", "item")
    placed = docs.join(hits, F.col("doc").eqNullSafe(F.col("_doc"))).join(items.select("item", "want"), "item")
    placed = placed.filter(F.slice("have", F.col("at") + 1, F.size("want")) == F.col("want"))
    return placed.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), "at", F.size("want").alias("n")).distinct()


def token_presence(docs: DataFrame, items: DataFrame, doc_id: str, doc_text: str, item_id: str, item_text: str, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """(doc, item) pairs where the item's tokens stand in the document in a row."""
    return token_places(docs, items, doc_id, doc_text, item_id, item_text, small_bytes).select(doc_id, item_id).distinct()
