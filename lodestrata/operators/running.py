"""Ordinals and offsets over whole tables, without a window over a whole scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BEFORE = (Window.unboundedPreceding, -1)


def block_of(value: Column, cuts: list, first: int = 0) -> Column:
    """How many of the sorted ``cuts`` are no larger than a value, by bisection."""
    if not cuts:
        return F.lit(first)
    middle = len(cuts) // 2
    return F.when(value >= F.lit(cuts[middle]), block_of(value, cuts[middle + 1 :], first + middle + 1)).otherwise(block_of(value, cuts[:middle], first))


def sums_before(df: DataFrame, scope: list[str], order: str, names: dict[str, str], blocks: int = 128) -> DataFrame:
    """Adds sums over the rows of the same scope with a smaller ``order``, which is unique in its scope; ``names`` maps a value's column to its sum's.

    ``blocks`` - 1 values of the order, chosen by their hash, cut it into blocks; totals by scope and block are summed
    up first, then the rows within a scope's block. So no task sees more of a scope than one block. Nulls of the order come first.
    """
    spread = df.filter(F.col(order).isNotNull()).select(order).distinct().orderBy(F.xxhash64(order)).limit(blocks - 1)
    cuts = sorted(r[0] for r in spread.collect())  # ``blocks`` at most
    rows = df.withColumn("_block", F.when(F.col(order).isNull(), -1).otherwise(block_of(F.col(order), cuts)))
    sums = lambda column, w: F.coalesce(F.sum(column).over(w.rowsBetween(*BEFORE)), F.lit(0))
    keys = [F.col(c).alias(f"_s{k}") for k, c in enumerate(scope)]
    marks = [f"_s{k}" for k in range(len(scope))]
    totals = rows.groupBy(*keys, F.col("_block").alias("_b")).agg(*[F.sum(v).alias(f"_t_{n}") for v, n in names.items()])
    firsts = totals.select(*marks, "_b", *[sums(f"_t_{n}", Window.partitionBy(*marks).orderBy("_b")).alias(f"_f_{n}") for n in names.values()])
    same = F.col("_block") == F.col("_b")
    for c, m in zip(scope, marks, strict=True):
        same &= F.col(c).eqNullSafe(F.col(m))
    own = rows.withColumns({f"_o_{n}": sums(v, Window.partitionBy(*scope, "_block").orderBy(order)) for v, n in names.items()})
    return own.join(firsts, same).select(*df.columns, *[(F.col(f"_o_{n}") + F.col(f"_f_{n}")).alias(n) for n in names.values()])
