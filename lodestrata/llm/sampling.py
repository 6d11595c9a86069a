"""A bounded sample by hash: the same rows in every run, whatever the partitions, and no group in one task.

Groups are counted, which gives a hash below which about twice the wanted number
lies; only those hashes come to the driver, where the smallest are chosen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

SPAN = 1 << 64


def chosen(rows: DataFrame, per_group: int, max_bytes: int) -> list[tuple]:
    """(g, h) of the rows to learn from; ``rows`` has g (group), h (hash of the text) and size.

    The smallest hashes of each group, ``per_group`` of them; every group's smallest hash comes first, then the others by
    their hash, and a text that would take the total over ``max_bytes`` is passed over unless it
    is its group's first, so that each group is learned. About 2 * per_group hashes a group come to the driver.
    """
    sizes = rows.filter("g is not null").groupBy("g").agg(F.approx_count_distinct("h", 0.05).alias("n"))
    # a share of the range of hashes in which about twice the wanted number lies
    share = F.least(F.lit(1.0), F.lit(2 * per_group + 64) / F.greatest("n", F.lit(1)))
    cuts = sizes.select("g", F.when(share >= 1, SPAN // 2 - 1).otherwise((share * float(SPAN) - SPAN / 2).cast("long")).alias("cut"))
    near = rows.join(F.broadcast(cuts), "g").filter("h <= cut")  # one row a group
    found = sorted((r.h, r.g, r.size) for r in near.groupBy("g", "h").agg(F.max("size").alias("size")).collect())
    firsts: dict = {}
    for h, g, size in found:
        firsts.setdefault(g, (h, size))
    out, left = [(g, h) for g, (h, _) in firsts.items()], max_bytes - sum(size for _, size in firsts.values())
    taken = dict.fromkeys(firsts, 1)
    # smallest hashes first in all groups alike, so that no group eats up the bytes
    for h, g, size in found:
        if h != firsts[g][0] and taken[g] < per_group and size <= left:
            taken[g] += 1
            left -= size
            out.append((g, h))
    return out


def fetched(rows: DataFrame, picked: list[tuple], *columns: str) -> list:
    """One row (g, h, ``columns``) for each picked (g, h); ``rows`` has g, h and these."""
    kind = rows.schema["g"].dataType.simpleString()
    keys = rows.sparkSession.createDataFrame(picked, f"g {kind}, h long")
    found = rows.select("g", "h", *columns).join(F.broadcast(keys), ["g", "h"])  # bounded by the sample's size
    return sorted(found.groupBy("g", "h").agg(*[F.min(c).alias(c) for c in columns]).collect())
