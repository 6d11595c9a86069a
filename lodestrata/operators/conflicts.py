"""Disagreeing sources: conflicts are reported, not resolved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T


def value_conflicts(df: DataFrame, scope: str, value: str) -> DataFrame:
    """Per scope: n_values, chosen (the value if there is one only) and values, sorted."""
    sets = df.filter(F.col(value).isNotNull()).groupBy(scope).agg(F.sort_array(F.collect_set(value)).alias("values"))
    return sets.select(scope, F.size("values").alias("n_values"), F.when(F.size("values") == 1, F.get("values", F.lit(0))).alias("chosen"), "values")


def normalized_conflicts(df: DataFrame, key: Column, value: str, normal: Column) -> DataFrame:
    """Keys whose values differ once normalised: key, n_normal, values (as written, sorted)."""
    groups = df.groupBy(key.alias("key")).agg(F.count_distinct(normal).alias("n_normal"), F.sort_array(F.collect_set(value)).alias("values"))
    return groups.filter("n_normal > 1")


def entry_date_conflicts(entries: DataFrame, heading: str = "heading", date: str = "date") -> DataFrame:
    """Entries of one heading with different dates; ranges agree if their end points do."""
    filled = entries.filter((F.coalesce(heading, F.lit("")) != "") & (F.coalesce(date, F.lit("")) != ""))
    return normalized_conflicts(filled, F.lower(T.collapse(heading)), date, T.date_key(date)).withColumnRenamed("key", "heading")
