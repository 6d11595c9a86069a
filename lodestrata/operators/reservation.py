"""Exclusive places: each stretch of a document serves one expected text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def reserved(offers: Column) -> Column:
    """Places given out, as an array of offers: greedy, in the order of the offers (structs with want, low and high, high exclusive).

    Each want gets its first offer that overlaps none given before.
    """
    state = F.filter(offers, lambda x: F.lit(False))

    def step(taken: Column, x: Column) -> Column:
        barred = F.exists(taken, lambda t: (t["want"] == x["want"]) | ((t["low"] < x["high"]) & (t["high"] > x["low"])))
        return F.when(barred, taken).otherwise(F.array_append(taken, x))

    return F.aggregate(offers, state, step)


def exclusive_places(places: DataFrame, scope: str, want: list[str], low: str = "low", high: str = "high", rank: list[Column] | None = None) -> DataFrame:
    """Per scope, which of the wanted texts have a place of their own: scope, want, low and high (null: none is left).

    ``places`` has every place of every wanted text. Longer texts choose first, then by ``want``, then the leftmost place; ``rank`` puts other
    columns before these. The fold is over one document's places, which its wanted texts bound.
    """
    order = rank or [(F.col(low) - F.col(high)).alias("shorter")]
    offer = F.struct(*order, F.struct(*want).alias("want"), F.col(low).alias("low"), F.col(high).alias("high"))
    folded = places.groupBy(scope).agg(F.sort_array(F.collect_set(offer)).alias("offers"))
    folded = folded.select(scope, F.array_distinct(F.transform("offers", lambda x: x["want"])).alias("wants"), reserved(F.col("offers")).alias("given"))
    one = folded.select(scope, "given", F.explode("wants").alias("want"))
    place = F.get(F.filter("given", lambda g: g["want"] == F.col("want")), F.lit(0))
    return one.withColumn("place", place).select(scope, *[F.col(f"want.{w}").alias(w) for w in want], F.col("place.low").alias(low), F.col("place.high").alias(high))
