"""Accounting: nothing is dropped in silence, and limits fail instead of truncating."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import matching, text as T, vocabulary as V
from . import segments as S


def line_kind(text: Column) -> Column:
    """What a line on its own may be, in the classifier's order."""
    return (
        F.when(T.heading_key(text).isNotNull(), "section_candidate")
        .when(T.unknown_heading(text), "unsupported_section_candidate")
        .when(T.contact_candidate(text), "contact_candidate")
        .when(T.date_header(text) & (F.length(text) <= 220), "date_candidate")
        .when(T.found(text, V.BULLET, "(?sU)"), "original_bullet")
        .otherwise("unclassified")
    )


def ledger(docs: DataFrame, claims: DataFrame, source: str, order: str, text: str) -> DataFrame:
    """Per source: blocks, visible lines (segments), those that a claim accounts for, and claims of no known kind.

    ``claims`` (``order``, line, text) come from elsewhere: each is joined back to its document and counts if its line is
    a visible one there, once. ``complete`` says that no line is left and no claim is beside a line; a source that drops or doubles a claim isn't.
    """
    lines = docs.select(F.col(source).alias("source"), F.col(order).alias("order"), T.visible_line_count(text).alias("n"), F.transform(T.lines(F.col(text)), lambda x: T.strip(x) != "").alias("shown"))
    bullet = T.found("text", V.BULLET, "(?sU)")
    made = claims.withColumn("plain", ~bullet).groupBy(F.col(order).alias("_order")).agg(F.count("*").alias("claims"), F.count_if("plain").alias("plain"), F.collect_set("line").alias("claimed"))
    both = lines.join(made, F.col("order").eqNullSafe(F.col("_order")), "left")
    held = F.size(F.filter("claimed", lambda k: F.coalesce(F.get("shown", k - 1), F.lit(False))))
    none = lambda c: F.coalesce(c, F.lit(0))
    sums = both.groupBy("source").agg(F.count("*").alias("source_blocks"), F.sum(none("n")).cast("long").alias("segments"), F.sum(none(held)).cast("long").alias("accounted_segments"), F.sum(none("plain")).cast("long").alias("unclassified_segments"), F.sum(none("claims")).alias("_claims"))
    complete = (F.col("segments") == F.col("accounted_segments")) & (F.col("_claims") == F.col("accounted_segments"))
    return sums.withColumn("complete", complete).drop("_claims").withColumnRenamed("source", source)


def page_coverage(blocks: DataFrame, page: str) -> DataFrame:
    """Per page: blocks, segments, their kinds; ``complete`` says that as many lines have a kind as the blocks show, counted on their own."""
    own = blocks.filter("seq is not null")
    lines = S.segments(own, "text", keep=[page, "seq"]).withColumn("kind", line_kind(F.col("text")))
    kinds = ["section_candidate", "unsupported_section_candidate", "contact_candidate", "date_candidate", "original_bullet", "unclassified"]
    per_block = lines.groupBy(page, "seq").agg(F.count("*").alias("segments"), *[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
    shown = own.select(F.col(page).alias("_page"), F.col("seq").alias("_seq"), T.visible_line_count("text").alias("shown"))
    both = shown.join(per_block, F.col("_page").eqNullSafe(F.col(page)) & (F.col("_seq") == F.col("seq")), "left")
    counts = both.groupBy(F.col("_page").alias(page)).agg(F.count("seq").alias("blocks"), F.sum("segments").alias("segments"), *[F.sum(k).alias(k) for k in kinds], F.sum("shown").alias("_shown"))
    return counts.withColumn("complete", F.col("_shown") == sum((F.col(k) for k in kinds), F.lit(0))).drop("_shown")


def exclusive_coverage(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Rows of (keep, expected, text): n_expected and missing, the numbers of expected texts without a place of their own."""
    return rows.select(*keep, F.size("expected").alias("n_expected"), matching.missing_texts("expected", "text").alias("missing"))


def violations(df: DataFrame, rules: dict[str, Column], *names: Column) -> DataFrame:
    """One row per broken rule, all rules in one pass: the names and the rule."""
    broken = F.filter(F.array(*[F.when(broken, F.lit(rule)) for rule, broken in rules.items()]), lambda r: r.isNotNull())
    return df.select(*names, F.explode_outer(broken).alias("rule")).filter("rule is not null")


def budgets(docs: DataFrame, source: str, text: str, most_blocks: int = 10_000, most_chars: int = 2_000_000, most_bytes: int = 10 * 1024 * 1024) -> DataFrame:
    """Per source: sums and whether they break a limit. Limits are guards that a caller acts on."""
    sums = docs.groupBy(source).agg(F.count("*").alias("n_blocks"), F.sum(F.length(text)).alias("n_chars"), F.sum(F.octet_length(text)).alias("n_bytes"), F.max(F.octet_length(text)).alias("_largest"))
    return sums.select(source, "n_blocks", "n_chars", "n_bytes", (F.col("n_blocks") > most_blocks).alias("too_many_blocks"), (F.col("n_chars") > most_chars).alias("too_many_chars"), (F.col("_largest") > most_bytes).alias("too_large"))
