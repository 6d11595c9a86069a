"""Identity, reference and order checks: each returns the rows that break the rule, or a verdict per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def duplicate_ids(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def unknown_references(df: DataFrame, ref: str, known: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``ref`` no row of ``known`` has."""
    return df.join(known.select(F.col(key).alias("_key")), F.col(ref) == F.col("_key"), "left_anti")


def temporal_validity(citations: DataFrame, facts: DataFrame, scope: str, cited: str, at: str, known: str, superseded: str | None = None) -> DataFrame:
    """Adds ``validity`` to citations: unknown, future, superseded or valid, as of the citing position."""
    names = [F.col(scope).alias("_scope"), F.col(known).alias("_known")] + ([F.col(superseded).alias("_gone")] if superseded else [])
    joined = citations.join(facts.select(*names).withColumn("_hit", F.lit(True)), (F.col(scope) == F.col("_scope")) & (F.col(cited) == F.col("_known")), "left")
    verdict = F.when(F.col("_hit").isNull(), "unknown").when(F.col("_known") > F.col(at), "future")
    if superseded:
        verdict = verdict.when(F.col("_gone") <= F.col(at), "superseded")
    return joined.select(*citations.columns, verdict.otherwise("valid").alias("validity"))


def contiguity(df: DataFrame, scope: str, number: str) -> DataFrame:
    """Per scope: n, first, last, and whether the numbers run from the first without gap or repeat."""
    agg = df.groupBy(scope).agg(F.count("*").alias("n"), F.min(number).alias("first"), F.max(number).alias("last"), F.count_distinct(number).alias("distinct"))
    return agg.select(scope, "n", "first", "last", ((F.col("distinct") == F.col("n")) & (F.col("last") - F.col("first") + 1 == F.col("n"))).alias("contiguous"))


def quotes_in(quotes: DataFrame, texts: DataFrame, on: list[str], quote: str, text: str) -> DataFrame:
    """Adds ``contained``: whether the text with the same keys has the quote, which must not be blank."""
    joined = quotes.join(texts.select(*on, F.col(text).alias("_text")), on, "left")
    return joined.select(*quotes.columns, F.coalesce((F.trim(quote) != "") & F.contains("_text", F.col(quote)), F.lit(False)).alias("contained"))


def exhaustive(required: DataFrame, given: DataFrame, *keys: str) -> DataFrame:
    """Breaches of "each required key exactly once": problem (missing, unexpected or repeated) and the key."""
    given = given.select(*keys).groupBy(*keys).agg(F.count("*").alias("given"))
    both = required.select(*keys).distinct().withColumn("required", F.lit(True)).join(given, list(keys), "full")
    problem = F.when(F.col("given").isNull(), "missing").when(F.col("required").isNull(), "unexpected").when(F.col("given") > 1, "repeated")
    return both.select(problem.alias("problem"), *keys).filter("problem is not null")


def stale(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """Names whose digest changed, appeared or went: key, state, before, after."""
    both = before.select(key, F.col(digest).alias("before")).join(after.select(key, F.col(digest).alias("after")), key, "full")
    state = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "missing").otherwise("changed")
    return both.filter(~F.col("before").eqNullSafe(F.col("after"))).select(key, state.alias("state"), "before", "after")


def carry_forward(df: DataFrame, scope: str, order: str, value: Column, name: str) -> DataFrame:
    """Adds the last value that isn't null up to each row."""
    w = Window.partitionBy(scope).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def fingerprint_groups(df: DataFrame, content: str, id_col: str) -> DataFrame:
    """Contents that occur more than once: sha256, n, first_id."""
    return df.filter(F.col(content).isNotNull()).groupBy(F.sha2(content, 256).alias("sha256")).agg(F.count("*").alias("n"), F.min(id_col).alias("first_id")).filter("n > 1")


def ordered_distinct(df: DataFrame, scope: str, value: str, *order: str) -> DataFrame:
    """Each scope's distinct values in the order of their first appearance."""
    firsts = df.groupBy(scope, value).agg(F.min(F.struct(*order)).alias("first"))
    return firsts.groupBy(scope).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", value))), lambda s: s[value]).alias("values"))


def revision_states(df: DataFrame, scope: str, revision: str, *order: str) -> DataFrame:
    """Adds state (CURRENT for the newest row of a scope, else STALE) and superseded_by (the newest)."""
    newest = df.groupBy(scope).agg(F.max(F.struct(*order, revision)).alias("_newest"))
    current = F.col(revision) == F.col(f"_newest.{revision}")
    return df.join(newest, scope).select(*df.columns, F.when(current, "CURRENT").otherwise("STALE").alias("state"), F.when(~current, F.col(f"_newest.{revision}")).alias("superseded_by"))


def global_ids(df: DataFrame, scope: str, order: str, prefix: str = "claim-", blocks: int = 256) -> DataFrame:
    """Gapless ids in (scope, order) order without bringing everything to one task.

    ``blocks`` - 1 scopes, chosen by their hash, cut the scopes' order into blocks; the
    blocks' totals are summed up, then the scopes' within each block, then rows are
    ranked within their scope.
    """
    counts = df.groupBy(scope).agg(F.count("*").alias("_n"))
    cuts = sorted(r[0] for r in counts.filter(F.col(scope).isNotNull()).select(scope).orderBy(F.xxhash64(scope)).limit(blocks - 1).collect())
    block = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(scope))) if cuts else F.lit(0)
    counts = counts.withColumn("_block", F.coalesce(block, F.lit(-1)))
    running = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = counts.groupBy("_block").agg(F.sum("_n").alias("_n"))
    firsts = totals.select("_block", running(Window.orderBy("_block")).alias("_first"))  # at most ``blocks`` rows
    before = counts.withColumn("_before", running(Window.partitionBy("_block").orderBy(scope))).join(firsts, "_block")
    before = before.select(F.col(scope).alias("_scope"), (F.col("_before") + F.col("_first")).alias("_before"))
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(scope).orderBy(order)))
    out = ranked.join(before, F.col(scope).eqNullSafe(F.col("_scope")))
    return out.withColumn("claim_id", F.concat(F.lit(prefix), F.lpad((F.col("_rank") + F.col("_before")).cast("string"), 6, "0"))).drop("_rank", "_before", "_scope")
