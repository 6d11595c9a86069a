"""Headers of one to three lines, found by looking ahead; a header consumes the lines it takes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T, vocabulary as V

SHORT, LONG = 140, 220


def dated_flags(line: Column) -> Column:
    """alone: a header by itself. opens: may be a header's first line. part: may stand within one. closes: a date that ends one.

    A dated line with a heading of its own completes no line before it, and neither a line that mentions a date
    in a sentence nor a bullet or a section's heading is part of a header.
    """
    bullet = T.found(line, V.BULLET, "(?sU)")
    fragment = (F.length(line) <= SHORT) & T.heading_fragment(line) & ~bullet & T.heading_key(line).isNull() & ~T.unknown_heading(line)
    dated, has_date = T.date_header(line), T.date_span(line) != ""
    return F.struct(
        (dated & ~bullet & (F.length(line) <= LONG)).alias("alone"),
        (fragment & ~has_date).alias("opens"),
        (fragment & dated & (T.entry_heading(line) == "")).alias("closes"),
    )


def reach(flags: Column, i: Column) -> Column:
    """How many lines after line ``i`` (from 0) its header takes; null if it begins none."""
    at = lambda k, name: F.coalesce(F.get(flags, i + k)[name], F.lit(False))
    return F.when(at(0, "alone"), 0).when(at(0, "opens") & at(1, "closes"), 1).when(at(0, "opens") & at(1, "opens") & at(2, "closes"), 2)


def header_groups(docs: DataFrame, id_col: str, text: str = "text", flags: Callable[[Column], Column] = dated_flags) -> DataFrame:
    """Headers in the order of the lines: id, line (from 1) and reach (0, 1 or 2 lines more).

    One fold over a document's lines: a line that a header has taken begins none of its own, so headers
    never overlap. All in the row, without a shuffle.
    """
    rows = docs.select(id_col, F.transform(T.lines(F.col(text)), flags).alias("flags"))
    rows = rows.select(id_col, F.transform(F.sequence(F.lit(0), F.size("flags") - 1), lambda i: F.struct((i + 1).alias("line"), reach(F.col("flags"), i).alias("reach"))).alias("lines"))
    starts = F.filter("lines", lambda x: x["reach"].isNotNull())  # only these can change the state
    state = F.struct(F.lit(1).alias("free"), F.array().cast("array<struct<line:int,reach:int>>").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        taken = F.struct((x["line"] + x["reach"] + 1).alias("free"), F.array_append(acc["found"], x).alias("found"))
        return F.when(x["line"] >= acc["free"], taken).otherwise(acc)

    found = F.aggregate(starts, state, step, lambda acc: acc["found"])
    return rows.select(id_col, F.explode_outer(found).alias("h")).filter("h is not null").select(id_col, "h.line", "h.reach")
