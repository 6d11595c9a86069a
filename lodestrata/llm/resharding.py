"""Resharding by minimum-cost flow.

Old shards are cut into blocks by a hash of the row number; only the blocks'
byte and row totals (``blocks`` per old shard at most) come to the driver. A
transportation problem from the blocks' bytes to new capacities, where a byte that
stays costs nothing and a byte that moves costs one, says how many bytes of each
block go to each new shard. A block that goes to one shard goes whole; the few that
the flow divides are dealt out row by row, by byte position: what stays comes first,
each transfer takes the next stretch. An old shard's first blocks stay, so that what stays
keeps its place there; what comes in follows.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window, functions as F

from .columns import numbered, place
from .scratch import Scratch

BLOCKS, ROWS_A_BLOCK = (256, 32_768), 200_000


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Cheapest flow of all supplies into the capacities, by successive shortest paths.

    Made for many supplies, few capacities and few different rows of costs: a path leads from
    a supply over capacities, each of which passes flow on that it holds, and supplies of
    equal costs pass it on alike. Paths of one step at a supply's least cost come first.
    Every path fills a supply or a capacity, or takes all that a supply has in a capacity, so the
    number of paths doesn't depend on the amounts.
    """
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities are too small")
    shards = range(len(capacity))
    costs = [tuple(c) for c in cost]
    flow = [[0] * len(capacity) for _ in supply]
    left, room = list(supply), list(capacity)
    held: list[dict[tuple, list[int]]] = [{} for _ in shards]  # by capacity and costs: the supplies with flow there

    def put(i: int, j: int, amount: int) -> None:
        if not flow[i][j]:
            held[j].setdefault(costs[i], []).append(i)
        flow[i][j] += amount

    def take(i: int, j: int, amount: int) -> None:  # i is the last of its list
        flow[i][j] -= amount
        if not flow[i][j]:
            held[j][costs[i]].pop()

    for i, own in enumerate(costs):
        for j in shards:
            amount = min(left[i], room[j])
            if amount and own[j] == min(own):
                put(i, j, amount)
                left[i] -= amount
                room[j] -= amount
    for i, own in enumerate(costs):
        while left[i]:
            dist, back = list(own), [None] * len(capacity)
            changed = True
            while changed:
                changed = False
                for a in shards:
                    for kind, ids in held[a].items():
                        for b in shards if ids else ():
                            if dist[a] + kind[b] - kind[a] < dist[b]:
                                dist[b], back[b], changed = dist[a] + kind[b] - kind[a], (a, ids[-1]), True
            end = v = min((j for j in shards if room[j]), key=lambda j: dist[j])
            steps = []
            while back[v]:
                a, k = back[v]
                steps.append((k, a, v))
                v = a
            amount = min(left[i], room[end], *(flow[k][a] for k, a, _ in steps))
            for k, a, _ in steps:
                take(k, a, amount)
            for k, _, b in steps:
                put(k, b, amount)
            put(i, v, amount)
            left[i] -= amount
            room[end] -= amount
    return flow


def even_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def plan_transfers(sizes: list[int], shards: int, olds: list[int] | None = None) -> list[list[int]]:
    """Bytes from each block to each of ``shards`` even new shards.

    Block i lies in old shard ``olds[i]``, by default i: a block a shard. Shard j of the old layout is shard j of the new one.
    """
    cost = [[int(i != j) for j in range(shards)] for i in (range(len(sizes)) if olds is None else olds)]
    return min_cost_flow(sizes, even_capacities(sum(sizes), shards), cost)


def reshard(docs: DataFrame, old_shard: Column, old_shards: int, shards: int = 8, text: str = "text", id_col: str = "doc_id", blocks: int | None = None) -> DataFrame:
    """Deals all rows out to ``shards`` shards of near equal bytes, moving as few bytes as possible.

    ``old_shard`` gives 0 to ``old_shards`` - 1. Returns, for every row, the id,
    size (UTF-8 bytes + 1; null text: 1), text_crc32, law ``bytes``, shard, slot
    (gapless from 0 in each shard), grown_shard (null), old_shard, moved, block and old_slot (the
    row's place in its old shard, in block order; a row that isn't moved keeps it as its slot). Shards
    differ from their capacity by half of the rows at the cuts at most. Repeated
    rows, ties, null ids and null texts are rows like all others, and a very long text moves
    as one row; an empty table gives no rows; other columns are ignored.

    ``blocks`` per old shard, by default one for about ROWS_A_BLOCK rows, but BLOCKS[0] at least
    and BLOCKS[1] at most, come to the driver as totals and are ranked in a task each.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "reshard")
    own = numbered(docs.select("*", old_shard.cast("int")))  # the last column
    kept = F.coalesce(F.col(place(docs, text)), F.lit(""))
    rows = scratch.save(own.select(F.col(place(docs, id_col)).alias("id"), (F.octet_length(kept) + 1).cast("long").alias("size"), F.crc32(kept.cast("binary")).alias("crc"), F.col(own.columns[-1]).alias("old"), F.monotonically_increasing_id().alias("row")))
    blocks = blocks or min(BLOCKS[1], max(BLOCKS[0], rows.count() // (old_shards * ROWS_A_BLOCK)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))

    # at most old_shards * blocks rows
    totals = sorted(tuple(r) for r in rows.groupBy("old", "block").agg(F.sum("size"), F.count("*")).collect())
    if any(t[0] is None or not 0 <= t[0] < old_shards for t in totals):
        raise ValueError("old_shard is out of range")
    flow = plan_transfers([t[2] for t in totals], shards, [t[0] for t in totals])
    whole, divided = [], []  # (old, block, shard, low, high), (first row, rows)
    before, counts = {}, [0] * old_shards
    for (old, block, _, n), out in zip(totals, flow, strict=True):
        before[old, block] = counts[old]
        counts[old] += n
        order = sorted((j for j in range(shards) if out[j]), key=lambda j: (j != old, j))
        low = 0
        for j in order:
            part = (old, block, j, low, low + out[j])
            low += out[j]
            if len(order) == 1:
                whole.append((part, (0, n)))
            else:
                divided.append(part)

    def dealt(some: DataFrame, parts: list[tuple], schema: str) -> DataFrame:
        at = Window.partitionBy("old", "block").orderBy("row")
        return (
            some.withColumns({"start": F.sum("size").over(at.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"), "nth": F.row_number().over(at) - 1})
            .join(F.broadcast(spark.createDataFrame(parts, schema)), ["old", "block"])  # at most one row a block, and the few cuts
            .filter("2 * start + size >= 2 * low and 2 * start + size < 2 * high")  # by a row's middle
        )

    schema = "old int, block int, shard int, low long, high long"
    found = {}
    if divided:  # at most a few for each new shard
        cut = spark.createDataFrame(sorted({p[:2] for p in divided}), "old int, block int")
        parts = dealt(rows.join(F.broadcast(cut), ["old", "block"]), divided, schema)
        found = {tuple(r)[:3]: tuple(r)[3:] for r in parts.groupBy("old", "block", "shard").agg(F.min("nth"), F.count("*")).collect()}
    placed, filled = [], [0] * shards
    for part, (first, n) in sorted(whole + [(p, found.get(p[:3], (0, 0))) for p in divided], key=lambda p: (p[0][0] != p[0][2], p)):
        placed.append((*part, before[part[:2]], filled[part[2]] - first))
        filled[part[2]] += n
    return dealt(rows, placed, schema + ", before long, shift long").select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("nth") + F.col("shift")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("old").alias("old_shard"), (F.col("old") != F.col("shard")).alias("moved"), "block", (F.col("nth") + F.col("before")).alias("old_slot")
    )


def affected(placement: DataFrame) -> list[int]:
    """Shards that lose or gain rows; the files of the others stay as they are."""
    moved = placement.filter("moved").select(F.explode(F.array("old_shard", "shard")).alias("s")).distinct()
    return sorted(r.s for r in moved.collect())  # one number a shard


def rewrite(docs: DataFrame, placement: DataFrame, out_dir: str, text: str = "text", id_col: str = "doc_id") -> list[int]:
    """Writes the affected shards as ``out_dir/shard=N``, rows in slot order within each file; returns their numbers.

    Rows keep all their columns; of these one named shard or slot is written as shard_before
    or slot_before. Repeated rows get a place each; null ids and texts are values like others.
    """
    shards = affected(placement)
    own = numbered(docs)
    kept = F.coalesce(F.col(place(docs, text)), F.lit(""))
    key = ["_id", "_crc", "_size", "_nth"]
    repeat = Window.partitionBy("_id", "_crc", "_size").orderBy("_id")
    side = lambda df, i, c, s: df.withColumns({"_id": F.coalesce(i.cast("string"), F.lit("")), "_crc": c, "_size": s}).withColumn("_nth", F.row_number().over(repeat))
    left = side(own, F.col(place(docs, id_col)), F.crc32(kept.cast("binary")), (F.octet_length(kept) + 1).cast("long"))
    right = side(placement.select(F.col(id_col).alias("k"), "text_crc32", "size", "shard", "slot"), F.col("k"), F.col("text_crc32"), F.col("size"))
    joined = left.join(right.filter(F.col("shard").isin(shards)).select(*key, "shard", "slot"), key)
    names = [f"{c}_before" if c.lower() in ("shard", "slot") else c for c in docs.columns]
    out = joined.select(*own.columns, "shard", "slot").toDF(*names, "shard", "slot")
    out.repartition("shard", F.expr("slot div 1000000")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(out_dir)
    return shards


def shard_of(bounds: list[int], position: int) -> int:
    """Number of the stretch that holds a byte position, for stretches that end at ``bounds``."""
    return bisect_right(bounds, position)
