"""Pairs within groups, without a row for each pair, and connected components.

Members of one bucket are compared inside a task. A bucket of more than
``block`` members, or of more weight than ``load``, is cut into chunks by a hash of
the member, and each pair of chunks is a unit of its own, so no task ever holds more
than two chunks of a bucket; what a unit reports grows with its members, not with
its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch
from .spans import runs

UNIT = ["bucket", "low", "high"]


def units(entries: DataFrame, scratch: Scratch, block: int = 512, load: int | None = None) -> DataFrame:
    """Entries (bucket, member, ...) of buckets with two members or more, once for each unit: adds low, high and chunk.

    With ``load``, entries have a weight too, of which a chunk has about so much.
    """
    heavy = F.sum("weight") / load if load else F.lit(0)
    counts = entries.groupBy("bucket").agg(F.count("*").alias("n"), F.ceil(F.greatest(F.count("*") / block, heavy)).alias("chunks")).filter("n > 1")
    counts = scratch.save(counts.select("bucket", F.least("chunks", "n").cast("int").alias("chunks")))
    dealt = entries.join(counts, "bucket").withColumn("chunk", F.pmod(F.xxhash64("member"), F.col("chunks")).cast("int"))
    unit = F.explode(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda x: F.struct(F.least("chunk", x).alias("low"), F.greatest("chunk", x).alias("high"))))
    return dealt.withColumn("unit", unit).select("*", "unit.low", "unit.high").drop("unit", "chunks")


def by_unit(df: DataFrame) -> DataFrame:
    return df.repartition(*UNIT).sortWithinPartitions(*UNIT)


def pair_indexes(chunk: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that a unit compares: within its chunk, or across its two chunks."""
    if low == high:
        return np.triu_indices(len(chunk), 1)
    left, right = np.flatnonzero(chunk == low), np.flatnonzero(chunk == high)
    return np.repeat(left, len(right)), np.tile(right, len(left))


def each_unit(batches: Iterable[pa.RecordBatch], work: Callable[[tuple, pa.Table], pa.RecordBatch | None]) -> Iterator[pa.RecordBatch]:
    """Calls ``work`` with each unit's rows; puts its results together."""
    for table in runs(batches, UNIT):
        cols = [table.column(k).to_numpy() for k in UNIT]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        found = []
        for a, b in zip([0, *cuts], [*cuts, table.num_rows], strict=True):
            if b - a > 1 and (out := work(tuple(int(c[a]) for c in cols), table.slice(a, b - a))) is not None:
                found.append(out)
        if found:
            yield from pa.Table.from_batches(found).combine_chunks().to_batches(max_chunksize=10_000)


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Number of the smallest member that each of n members reaches over the links."""
    root = np.arange(n)
    while len(left):
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        root = root[root]
        if (root == before).all():
            break
    while not (root[root] == root).all():
        root = root[root]
    return root


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for each node of edges (a, b), root the smallest node that it reaches.

    Large-star and small-star steps in turn; each round is written to the shared
    folder, and nothing but its size and a checksum comes to the driver. Smallest
    neighbours are written too: the join with them can then be split at a hub.
    """

    def star(links: DataFrame, both: bool) -> DataFrame:
        # small star: neighbours below and the node itself go to the smallest; large star: neighbours above do
        sides = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        if both:
            sides = sides.unionByName(sides.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.save(sides.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
        lows.append(low)
        joined = sides.join(low, "u")
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")) if both else joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.filter(F.col("a") != F.col("b")).distinct()

    def state(links: DataFrame) -> tuple:
        return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    current = scratch.save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    seen = state(current)
    while seen[0]:
        lows: list[DataFrame] = []
        wide = scratch.save(star(current, True))
        following = scratch.save(star(wide, False))
        scratch.drop(current, wide, *lows)
        current, before, seen = following, seen, state(following)
        if seen == before:
            break
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
