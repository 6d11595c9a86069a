"""Joins on shared elements and on keys with a second choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BLOCK = 1000  # of an element's sets, so many meet in one unit


def overlapping_sets(members: DataFrame, set_id: str, element: str, least: int = 1) -> DataFrame:
    """Pairs of sets that share ``least`` elements or more: a, b (a < b), shared and elements.

    Elements are ordered by how rare they are. Two sets that share enough meet at a rare one: among the first size - least + 1
    elements of each. So frequent elements are looked at only in sets that have little else, and a pair is
    compared at the first element it shares, once. An element of many sets is dealt out in pairs of blocks.
    """
    rows = members.select(F.col(set_id).alias("id"), F.col(element).alias("e")).filter("id is not null and e is not null").distinct()
    often = rows.groupBy("e").agg(F.count("*").alias("n"))
    sets = rows.join(often, "e").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "e"))), lambda x: x["e"]).alias("els"))
    sets = sets.filter(F.size("els") >= least)
    prefix = sets.select("id", "els", F.explode(F.slice("els", F.lit(1), F.size("els") - least + 1)).alias("e"))
    chunks = prefix.groupBy("e").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("chunks"), F.count("*").alias("met")).filter("met > 1")
    dealt = prefix.join(chunks, "e").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    unit = F.explode(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda x: F.struct(F.least("chunk", x).alias("low"), F.greatest("chunk", x).alias("high"))))
    dealt = dealt.withColumn("u", unit).select("e", "u.low", "u.high", "chunk", "id", "els")
    left, right = dealt.select("e", "low", "high", F.col("chunk").alias("ca"), F.col("id").alias("a"), F.col("els").alias("ea")), dealt.select("e", "low", "high", F.col("chunk").alias("cb"), F.col("id").alias("b"), F.col("els").alias("eb"))
    met = left.join(right, ["e", "low", "high"]).filter((F.col("a") < F.col("b")) & ((F.col("low") == F.col("high")) | (F.col("ca") != F.col("cb"))))
    both = met.withColumn("elements", F.array_intersect("ea", "eb"))
    first = F.get("elements", F.lit(0)) == F.col("e")
    return both.filter(first & (F.size("elements") >= least)).select("a", "b", F.size("elements").alias("shared"), F.sort_array("elements").alias("elements"))


def first_or_equal(rows: DataFrame, fields: DataFrame, scope: list[str], key: str, value: str) -> DataFrame:
    """Rows with the fields they stand for: the field of the same key, or else all fields of the same value.

    ``fields`` has each key once a scope. Adds field (a key of ``fields``; null if none) and tier (``key``, ``value`` or null).
    The second join gets only rows that the first one missed; null values equal nothing.
    """
    named = fields.select(*scope, F.col(key).alias("field"), F.col(value).alias("_value"))
    exact = rows.join(named.select(*scope, "field").withColumn(key, F.col("field")), [*scope, key], "left").select(*rows.columns, "field")
    hit = exact.filter("field is not null").withColumn("tier", F.lit("key"))
    missed = exact.filter("field is null").drop("field")
    equal = missed.join(named.withColumnRenamed("_value", value), [*scope, value], "left").select(*rows.columns, "field")
    return hit.unionByName(equal.withColumn("tier", F.when(F.col("field").isNotNull(), F.lit("value"))))
