"""Pages: recognised words to lines, sizes, and whether a rendering shows what it should."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import matching

A4 = (595.276, 841.89)
LEAST_CONFIDENCE = 0.75


def recognised_lines(words: DataFrame) -> DataFrame:
    """Words (doc_id, page, block, par, line, word, text, confidence) as lines; a line is as sure as its least sure word."""
    kept = words.filter("trim(text) <> ''")
    lines = kept.groupBy("doc_id", "page", "block", "par", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "text"))), lambda w: w["text"]), " ").alias("text"), F.min("confidence").alias("confidence"))
    return lines.withColumn("needs_review", F.col("confidence") < LEAST_CONFIDENCE)


def is_a4(width: Column, height: Column) -> Column:
    return (F.abs(width - A4[0]) < 1) & (F.abs(height - A4[1]) < 1)


def page_check(pages: DataFrame) -> DataFrame:
    """Per document (doc_id, page, width, height): pages, a4 (all of them) and contiguous (numbered 1, 2, ... without gap)."""
    sums = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.bool_and(is_a4(F.col("width"), F.col("height"))).alias("a4"), F.min("page").alias("low"), F.max("page").alias("high"), F.count_distinct("page").alias("distinct"))
    return sums.select("doc_id", "pages", "a4", ((F.col("low") == 1) & (F.col("high") == F.col("pages")) & (F.col("distinct") == F.col("pages"))).alias("contiguous"))


def text_report(fields: DataFrame, extracted: DataFrame) -> DataFrame:
    """Fields (doc_id, ord, path, value) that an extracted text (doc_id, text) lacks, each place serving one field: doc_id, status, missing."""
    wanted = fields.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "path", "value"))).alias("f"))
    both = wanted.join(extracted, "doc_id", "left").withColumn("m", matching.missing_texts(F.transform("f", lambda x: x["value"]), F.coalesce("text", F.lit(""))))
    absent = F.transform("m", lambda k: F.get("f", k)["path"])
    return both.select("doc_id", F.when(F.size("m") == 0, "passed").otherwise("failed").alias("status"), absent.alias("missing"))
