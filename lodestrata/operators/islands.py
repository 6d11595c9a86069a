"""Runs of neighbouring rows: continued lines, and cells that reach over several rows of a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T, vocabulary as V


def unfinished(before: Column, line: Column) -> Column:
    """A line goes on with the one before, which ends no sentence; a bullet begins anew."""
    return ~T.found(before, V.SENTENCE_END, T.U) & ~T.found(line, V.BULLET, "(?sU)")


def continued_lines(docs: DataFrame, id_col: str, text: str = "text", goes_on: Callable[[Column, Column], Column] = unfinished) -> DataFrame:
    """Lines merged with those that continue them: id, line_start, line_end, n_lines and text.

    ``goes_on`` tells by two neighbouring lines whether the second continues the first; a blank line ends an island. Lines are joined
    by a space, or by nothing after a hyphen, which is kept. All in the row, without a shuffle.
    """
    rows = docs.select(id_col, F.transform(T.lines(F.col(text)), T.strip).alias("l"))
    at = lambda i: F.get("l", i)
    starts = lambda i: (at(i) != "") & ((i == 0) | (F.coalesce(at(i - 1), F.lit("")) == "") | ~goes_on(at(i - 1), at(i)))
    ends = lambda i: (at(i) == "") | starts(i)
    nth = F.sequence(F.lit(0), F.size("l") - 1)
    rows = rows.select(id_col, "l", F.concat(F.filter(nth, ends), F.array(F.size("l"))).alias("ends"))
    # an island's end is the next place after its start that ends one; starts are among the ends
    rows = rows.withColumn("steps", F.transform("ends", lambda e, k: F.struct(e.alias("a"), F.get("ends", k + 1).alias("b"))))
    islands = F.filter("steps", lambda s: s["b"].isNotNull() & (at(s["a"]) != ""))
    one = rows.select(id_col, "l", F.explode_outer(islands).alias("s")).filter("s is not null")
    part = F.slice("l", F.col("s.a") + 1, F.col("s.b") - F.col("s.a"))
    merged = F.aggregate(F.slice(part, F.lit(2), F.size(part)), F.get(part, F.lit(0)), lambda acc, x: F.concat(acc, F.when(acc.endswith("-"), "").otherwise(" "), x))
    return one.select(id_col, (F.col("s.a") + 1).alias("line_start"), F.col("s.b").alias("line_end"), (F.col("s.b") - F.col("s.a")).alias("n_lines"), merged.alias("text"))


def anchored_islands(rows: DataFrame, scope: list[str], order: str, depth: str) -> DataFrame:
    """Adds island (from 1) and anchor: rows deeper than the row that began their island belong to it.

    A row begins an island if it is no deeper than any row of its scope before it: the rows that begin
    islands never get deeper, so the one before is always the least deep so far.
    """
    w = Window.partitionBy(*scope).orderBy(order)
    least = F.min(depth).over(w.rowsBetween(Window.unboundedPreceding, -1))
    begun = rows.withColumn("_begins", least.isNull() | (F.col(depth) <= least))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return begun.withColumns({"island": F.count_if("_begins").over(upto), "anchor": F.last(F.when(F.col("_begins"), F.col(order)), ignorenulls=True).over(upto)}).drop("_begins")


def row_spans(cells: DataFrame, table: str = "table", row: str = "row", column: str = "column", width: str = "width", state: str = "state") -> DataFrame:
    """Vertical merges of a table's cells: adds origin_row, origin_column and row_span.

    ``state`` is restart, continue or null, as word processors write it. In each column that a cell takes up, a restart and the
    continued cells right below it are an island; a continued cell belongs to the island of its first column, and
    its origin is the cell that began it. ``row_span`` of an origin counts it and the rows that continue it; a continued cell
    without an origin (nothing above, a gap, or a plain cell) has null for all three, other cells span one row.
    """
    key = [table, row, column]
    spread = cells.select(*key, state, F.explode(F.sequence(F.col(column), F.col(column) + F.col(width) - 1)).alias("_at"))
    above = Window.partitionBy(table, "_at").orderBy(row)
    begins = F.coalesce(F.col(state) != "continue", F.lit(True)) | (F.lag(row).over(above).isNull()) | (F.lag(row).over(above) != F.col(row) - 1)
    spread = spread.withColumn("_begins", begins).withColumn("_island", F.count_if("_begins").over(above.rowsBetween(Window.unboundedPreceding, 0)))
    first = Window.partitionBy(table, "_at", "_island").orderBy(row).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spread = spread.withColumns({"_row": F.first(row).over(first), "_column": F.first(column).over(first), "_opens": F.first(F.coalesce(F.col(state), F.lit(""))).over(first) == "restart"})
    goes_on = F.coalesce(F.col(state) == "continue", F.lit(False))
    own = spread.filter(F.col("_at") == F.col(column)).select(*key, goes_on.alias("_on"), F.when(~goes_on, F.col(row)).when(F.col("_opens"), F.col("_row")).alias("origin_row"), F.when(~goes_on, F.col(column)).when(F.col("_opens"), F.col("_column")).alias("origin_column"))
    spans = own.filter("_on and origin_row is not null").groupBy(F.col(table).alias("_t"), F.col("origin_row").alias("_r"), F.col("origin_column").alias("_c")).agg(F.count_distinct(row).alias("_more"))
    joined = own.join(spans, (F.col(table) == F.col("_t")) & (F.col("origin_row") == F.col("_r")) & (F.col("origin_column") == F.col("_c")), "left")
    return joined.select(*key, "origin_row", "origin_column", F.when(F.col("origin_row").isNotNull(), 1 + F.coalesce("_more", F.lit(0))).alias("row_span"))
