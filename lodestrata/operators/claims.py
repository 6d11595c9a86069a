"""Assembly of many sources: every line becomes a claim with a gapless number and a path that holds in the whole.

Each document numbers its own sections and lines in its row; what comes before it in its scope are two running sums.
Only documents and their counts are shuffled, and no task gets a scope as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from . import running


def visible_lines(text: Column) -> Column:
    """Lines that aren't blank: line (from 1) and text."""
    return F.filter(F.transform(T.lines(text), lambda x, i: F.struct((i + 1).alias("line"), T.strip(x).alias("text"))), lambda x: x["text"] != "")


def section_starts(lines: Column) -> Column:
    """Places in an array of visible lines where a section begins: the first, and each after a blank line. One past the last is added."""
    nth = F.when(F.size(lines) > 0, F.sequence(F.lit(0), F.size(lines) - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(nth, lambda i: (i == 0) | (F.get(lines, i)["line"] > F.get(lines, i - 1)["line"] + 1))
    return F.concat(starts, F.array(F.size(lines)))


def outlines(docs: DataFrame, scope: str, order: str, text: str) -> DataFrame:
    """scope, order, lines, starts, and how many sections and lines of the scope come before: sections_before, claims_before."""
    rows = docs.select(F.col(scope).alias("scope"), F.col(order).alias("order"), F.coalesce(visible_lines(F.col(text)), F.array().cast("array<struct<line:int,text:string>>")).alias("lines"))
    rows = rows.withColumn("starts", section_starts(F.col("lines")))
    counts = rows.select("scope", "order", (F.size("starts") - 1).alias("n_sections"), F.size("lines").alias("n_lines"))
    counts = running.sums_before(counts, ["scope"], "order", {"n_sections": "sections_before", "n_lines": "claims_before"})
    before = counts.select(F.col("scope").alias("_scope"), F.col("order").alias("_order"), "sections_before", "claims_before")
    return rows.join(before, F.col("scope").eqNullSafe(F.col("_scope")) & F.col("order").eqNullSafe(F.col("_order"))).drop("_scope", "_order")


def _sections(rows: DataFrame) -> DataFrame:
    """One row per section: its number in the scope, its lines, and the number of lines before it."""
    nth = F.filter(F.transform("starts", lambda s, k: F.struct(k.alias("k"), s.alias("a"), F.get("starts", k + 1).alias("b"))), lambda s: s["b"].isNotNull())
    one = rows.select("scope", "order", "lines", "sections_before", "claims_before", F.explode_outer(nth).alias("s")).filter("s is not null")
    return one.select("scope", "order", (F.col("sections_before") + F.col("s.k")).alias("section"), (F.col("claims_before") + F.col("s.a")).alias("before"), F.slice("lines", F.col("s.a") + 1, F.col("s.b") - F.col("s.a")).alias("lines"))


def assembled_claims(docs: DataFrame, scope: str, order: str, text: str = "text", prefix: str = "claim-") -> DataFrame:
    """One claim per visible line: scope, order, line, claim_id (gapless in the scope, by ``order`` and line), path and text.

    ``order`` is unique within a scope. A scope's sections are numbered on over its documents, and so are the claims.
    """
    rows = _sections(outlines(docs, scope, order, text)).select("scope", "order", "section", "before", F.posexplode("lines").alias("entry", "x"))
    number = F.col("before") + F.col("entry") + 1
    claim = F.concat(F.lit(prefix), F.lpad(number.cast("string"), F.greatest(F.lit(6), F.length(number.cast("string"))), "0"))
    path = F.concat(F.lit("sections["), F.col("section"), F.lit("].entries["), F.col("entry"), F.lit("]"))
    return rows.select(F.col("scope").alias(scope), F.col("order").alias(order), F.col("x.line").alias("line"), claim.alias("claim_id"), path.alias("path"), F.col("x.text").alias("text"))


def assembled_sections(docs: DataFrame, scope: str, order: str, wanted: Column, text: str = "text") -> DataFrame:
    """One row per section: scope, order, section, n_lines and section_id.

    ``wanted`` names a section by its first line, ``title``; of sections of one name in a scope the second gets the suffix -2, and so on.
    Names themselves end in no such suffix.
    """
    rows = _sections(outlines(docs, scope, order, text)).select("scope", "order", "section", F.size("lines").alias("n_lines"), F.get("lines", F.lit(0))["text"].alias("title"))
    rows = rows.withColumn("wanted", wanted).withColumn("one", F.lit(1))
    ranked = running.sums_before(rows.drop("title"), ["scope", "wanted"], "section", {"one": "same"})
    name = F.when(F.col("same") == 0, F.col("wanted")).otherwise(F.concat("wanted", F.lit("-"), F.col("same") + 1))
    return ranked.select(F.col("scope").alias(scope), F.col("order").alias(order), "section", "n_lines", name.alias("section_id"))
