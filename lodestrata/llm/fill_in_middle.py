"""Fill-in-middle transformation over an index of distinct texts.

Identical texts are grouped by their SHA-256 and byte length, and each distinct text travels
once. Documents travel without their texts and are joined back to it; the join brings the
documents of one text one after the other. For each distinct text the byte offsets at which its code points
begin are worked out once, as an Elias-Fano list: about two bits a code point in plain ASCII,
where a table of offsets takes eight bytes. Both ends of a document's seeded cut are selected from the list.

Texts with very many copies are cut off from the rest: their few rows are repeated
for shares of the copies, so that no task gets all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as Y

from . import worker
from .columns import numbered, place
from .scratch import Scratch

SAMPLE = 1024  # every so many-th value of a list has its place noted
MARKS = P, S, M = "<P>", "<S>", "<M>"
MOST_HOT = 10_000  # keys that are dealt with on their own


def elias_fano(values: np.ndarray, universe: int) -> bytes:
    """An ascending list of numbers below ``universe``: count, universe, places of every SAMPLE-th one bit, low bits, high bits."""
    n = len(values)
    low_bits = max(0, (universe // n).bit_length() - 1) if n else 0
    ones = (values >> low_bits) + np.arange(n)
    high = np.zeros((universe >> low_bits) + n + 1, dtype=np.uint8)
    high[ones] = 1
    low = ((values[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8) if low_bits else np.zeros(0, dtype=np.uint8)
    return b"".join([np.array([n, universe], dtype="<u8").tobytes(), ones[::SAMPLE].astype("<u8").tobytes(), np.packbits(low.reshape(-1)).tobytes(), np.packbits(high).tobytes()])


def select(coded: bytes, k: int) -> int:
    """The k-th value of a list; the universe for k = its count."""
    n, universe = np.frombuffer(coded, dtype="<u8", count=2).tolist()
    if k >= n:
        return universe
    low_bits = max(0, (universe // n).bit_length() - 1)
    samples = -(-n // SAMPLE)
    start = int(np.frombuffer(coded, dtype="<u8", count=1, offset=16 + 8 * (k // SAMPLE))[0])
    lows = 16 + 8 * samples
    highs = lows + (n * low_bits + 7) // 8
    # between two samples lie at most SAMPLE ones and as many zeros as values were skipped; read on until enough ones are met
    left, at, step = k % SAMPLE, start // 8, SAMPLE // 4
    seen = np.unpackbits(np.frombuffer(coded, dtype=np.uint8, count=min(step, len(coded) - highs - at), offset=highs + at))
    seen[: start % 8] = 0
    base = at * 8
    while True:
        ones = np.flatnonzero(seen)
        if left < len(ones):
            place_of = base + int(ones[left])
            break
        left -= len(ones)
        at += step
        base = at * 8
        seen = np.unpackbits(np.frombuffer(coded, dtype=np.uint8, count=min(step, len(coded) - highs - at), offset=highs + at))
    low = 0
    for b in range(low_bits):
        bit = k * low_bits + b
        low |= ((coded[lows + bit // 8] >> (7 - bit % 8)) & 1) << b
    return ((place_of - k) << low_bits) | low


def boundary_list(text: str) -> bytes:
    """Where the code points of a text begin in its UTF-8 bytes."""
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    return elias_fano(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))


class Lists(dict):
    """Boundary lists of the distinct texts met last, by key; about ``most`` bytes of them."""

    def __init__(self, most: int = 8 << 20):
        super().__init__()
        self.most, self.used = most, 0

    def of(self, key: bytes, text: str) -> bytes:
        coded = self.get(key)
        if coded is None:
            coded = boundary_list(text)
            if self.used > self.most:
                self.clear()
                self.used = 0
            self.used += len(coded) + 200
            self[key] = coded
        return coded


@F.pandas_udf(Y.StructType([Y.StructField("a", Y.LongType()), Y.StructField("b", Y.LongType())]))
def offsets(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Byte offsets of the code points ``low`` and ``high`` of a text, from the one list of its key."""
    lists = Lists()
    for keys, texts, lows, highs in batches:
        found = []
        for key, text, low, high in zip(keys, texts, lows, highs, strict=True):
            coded = lists.of(bytes(key), text)
            found.append((select(coded, low), select(coded, high)))
        yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def draws(id_col: Column, seed: int) -> list[Column]:
    """Four numbers below 2**32 from the seed and the decimal id; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def keyed(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """id, text (null: empty), and key and size, by which equal texts are known."""
    own = numbered(docs)
    t = F.coalesce(F.col(place(docs, text)), F.lit(""))
    return own.select(F.col(place(docs, id_col)).alias("id"), t.alias("text"), F.unhex(F.sha2(t, 256)).alias("key"), F.octet_length(t).alias("size"))


def fill_in_middle(docs: DataFrame, text: str = "text", id_col: str = "doc_id", seed: int = 1, rate: int = 90, spm: int = 20, share: int = 256) -> DataFrame:
    """Cuts every text at two seeded code points and turns it into one of three forms.

    Returns, per row: the id, n (code points), form, prefix_chars, middle_chars (null if
    plain) and output. Of the draws h1 to h4 of ``seed`` and the id, the prefix ends after the smaller of h1 % (n+1) and
    h2 % (n+1) code points and the middle after the larger; the form is plain if the text is empty or holds a
    mark, or if h3 % 100 >= ``rate``; else spm if h4 % 100 < ``spm``, else psm. Null texts are empty; texts of any length are
    cut whole; repeated rows, and rows with one id, are cut alike if their texts are. Null ids draw as empty ones.
    Other columns are ignored, whatever their names; an empty table gives no rows.

    A text with more than ``share`` copies, and more than one in MOST_HOT of all
    rows, gets a row of the index for each ``share`` of them, or that many.
    """
    spark = docs.sparkSession
    worker.small_batches(spark)
    scratch = Scratch(spark, "middle")
    base = keyed(docs, text, id_col)
    key = ["key", "size"]
    rows = scratch.save(base.select("id", *key, F.monotonically_increasing_id().alias("row")))
    total = rows.count()
    most = max(share, -(-total // MOST_HOT))
    hot = rows.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > most).select(*key, F.ceil(F.col("n") / most).cast("int").alias("shares"))
    hot = spark.createDataFrame(hot.collect(), hot.schema)  # fewer than MOST_HOT keys, since each has more than that share of the rows

    def distinct(of: DataFrame) -> DataFrame:
        return of.groupBy(*key).agg(F.first("text").alias("text"))

    small = F.broadcast(hot)
    few = rows.join(small, key, "left_anti").join(distinct(base.join(F.broadcast(hot.select(*key)), key, "left_anti")), key)
    many = rows.join(small, key).withColumn("part", F.pmod(F.xxhash64("row"), F.col("shares")).cast("int"))
    spread = distinct(base.join(F.broadcast(hot.select(*key)), key, "left_semi")).join(small, key).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    again = many.drop("shares").join(spread.drop("shares"), [*key, "part"]).drop("part")
    joined = few.unionByName(again).drop("row", "size")

    joined = joined.withColumn("n", F.length("text").cast("long"))
    h1, h2, h3, h4 = draws(F.col("id"), seed)
    cut = lambda h: h % (F.col("n") + 1)
    marked = F.exists(F.array(*[F.lit(m) for m in MARKS]), lambda m: F.contains(F.col("text"), m))
    plain = (F.col("n") == 0) | marked | (h3 % 100 >= rate)
    joined = joined.withColumns({"low": F.least(cut(h1), cut(h2)), "high": F.greatest(cut(h1), cut(h2)), "form": F.when(plain, "plain").when(h4 % 100 < spm, "spm").otherwise("psm")})
    joined = joined.withColumn("at", offsets("key", "text", "low", "high")).withColumn("raw", F.col("text").cast("binary"))
    piece = lambda a, b: F.substring(F.col("raw"), (a + 1).cast("int"), (b - a).cast("int")).cast("string")
    prefix, middle, suffix = piece(F.lit(0), F.col("at.a")), piece(F.col("at.a"), F.col("at.b")), piece(F.col("at.b"), F.octet_length("raw"))
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(F.lit(P), prefix, F.lit(S), suffix, F.lit(M), middle)).otherwise(F.concat(F.lit(S), suffix, F.lit(P), prefix, F.lit(M), middle))
    chars = lambda c: F.when(F.col("form") != "plain", c)
    return joined.select(F.col("id").alias(id_col), "n", "form", chars(F.col("low")).alias("prefix_chars"), chars(F.col("high") - F.col("low")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from: marks never stand in a text that was cut, so they can be told apart."""
    parts = F.split(output, f"{P}|{S}|{M}")
    first, second, last = F.get(parts, F.lit(1)), F.get(parts, F.lit(2)), F.get(parts, F.lit(3))
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, last, second)).otherwise(F.concat(second, last, first))


def digests(found: DataFrame) -> DataFrame:
    """Outputs by their SHA-256, and that of the text rebuilt from each."""
    back = restored(F.col("output"), F.col("form"))
    return found.withColumns({"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(back, 256)}).drop("output")


#: The whole result; marks are literals here.
ORACLE_SQL = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), d AS (
  SELECT *, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d
), p AS (
  SELECT *, substring(text, 1, a) AS prefix, substring(text, a + 1, b - a) AS middle, substring(text, b + 1) AS suffix FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""
