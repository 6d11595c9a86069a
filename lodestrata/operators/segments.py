"""Documents to located lines and paragraphs, without a shuffle: one row's arrays hold all it takes.

Generators are outer ones, without their null rows: of an inner one Spark first tests
the array's size, and for that works the array out a second time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T


def segments(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per line that isn't blank: the columns ``keep``, line_in_block (from 1), text (stripped), raw_text, indent."""
    keep = keep or [c for c in docs.columns if c != text]
    rows = docs.select(*keep, F.posexplode_outer(T.lines(F.col(text))).alias("at", "raw_text")).filter("at is not null")
    out = rows.select(*keep, (F.col("at") + 1).alias("line_in_block"), T.strip("raw_text").alias("text"), "raw_text", T.indent("raw_text").alias("indent"))
    return out.filter("text <> ''")


def paragraphs(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Groups of lines between blank ones: the columns ``keep``, paragraph (from 1), line_start, line_end, text."""
    keep = keep or [c for c in docs.columns if c != text]
    rows = docs.select(*keep, F.split(F.regexp_replace(F.col(text), "\r\n?", "\n"), "\n").alias("lines"))
    # places of blank lines, and one before the first and after the last line; paragraphs are the gaps
    blank = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: T.strip(F.get("lines", i)) == "")
    rows = rows.select(*keep, "lines", F.concat(F.array(F.lit(-1)), blank, F.array(F.size("lines"))).alias("edges"))
    gaps = F.filter(F.transform(F.sequence(F.lit(0), F.size("edges") - 2), lambda i: F.struct((F.get("edges", i) + 2).alias("a"), F.get("edges", i + 1).alias("b"))), lambda g: g["b"] >= g["a"])
    rows = rows.select(*keep, "lines", F.posexplode_outer(gaps).alias("at", "gap")).filter("at is not null")
    return rows.select(*keep, (F.col("at") + 1).alias("paragraph"), F.col("gap.a").alias("line_start"), F.col("gap.b").alias("line_end"), T.strip(F.array_join(F.slice("lines", F.col("gap.a"), F.col("gap.b") - F.col("gap.a") + 1), "\n")).alias("text"))


def lookahead_headers(docs: DataFrame, id_col: str, text: str = "text", short: int = 140, long: int = 220) -> DataFrame:
    """Lines that a date range heads, alone or within the next two short lines: id, line, reach (0, 1 or 2).

    A dated line that has a heading of its own completes no line before it, and a
    line that mentions a date in a sentence is no part of a header.
    """
    look = lambda x: F.struct(T.date_header(x).alias("dated"), (T.date_span(x) != "").alias("has_date"), (T.entry_heading(x) == "").alias("bare"), ((F.length(x) <= short) & T.heading_fragment(x)).alias("part"), F.length(x).alias("n"))
    rows = docs.select(id_col, F.transform(T.lines(F.col(text)), look).alias("l"))

    def reach(i):
        at = lambda k: F.get("l", i + k)
        closes = lambda k: at(k)["dated"] & at(k)["bare"] & at(k)["part"]
        opens = lambda k: at(k)["part"] & ~at(k)["has_date"]
        return F.when(at(0)["dated"] & (at(0)["n"] <= long), 0).when(opens(0) & closes(1), 1).when(opens(0) & opens(1) & closes(2), 2)

    found = F.filter(F.transform(F.sequence(F.lit(0), F.size("l") - 1), lambda i: F.struct((i + 1).alias("line"), reach(i).alias("reach"))), lambda s: s["reach"].isNotNull())
    return rows.select(id_col, F.explode_outer(found).alias("s")).filter("s is not null").select(id_col, "s.line", "s.reach")


def short_line_pairs(docs: DataFrame, id_col: str, text: str = "text", short: int = 40) -> DataFrame:
    """Short lines and the lengths of the two lines after them: id, line, n, next_n, after_n."""
    rows = docs.select(id_col, F.transform(T.lines(F.col(text)), lambda x: F.length(x)).alias("n"))
    found = F.filter(F.transform(F.sequence(F.lit(0), F.size("n") - 1), lambda i: F.struct((i + 1).alias("line"), F.get("n", i).alias("n"), F.get("n", i + 1).alias("next_n"), F.get("n", i + 2).alias("after_n"))), lambda s: s["n"] <= short)
    return rows.select(id_col, F.explode_outer(found).alias("s")).filter("s is not null").select(id_col, "s.*")
