"""Near-duplicate vectors through a pivot-permutation index.

A vector is described by the order of its nearest pivots, of which the first
``prefix`` are kept. Vectors that are close see the pivots in much the same order,
so candidates are those that share at least ``shared`` of them. The inverted lists
are kept by each combination of ``shared`` pivots of the prefix; a pair is looked
at only in the list of its smallest common combination. Lists hold numbers and sign
sketches, no vectors: pairs whose sketches differ in too many bits are dropped there,
vectors are fetched for the rest, and their cosine is computed in double precision.

Pivots are random directions, the same in every run: how often a pair is found then
depends on its cosine only, however much of the data lies in one group. How many
there are, and how many a prefix has, follows from the number of vectors: of all
settings that find ``recall`` of random pairs at the threshold itself, the one with
the least expected work. Every vector is indexed. Equal vectors are one member with a
count. Lists of any length are worked off in blocks (see ``pairs``).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import worker
from .columns import fingerprint, numbered, place
from .hashing import column
from .pairs import UNIT, by_unit, components, each_unit, forest, units
from .scratch import Scratch

BITS = 128  # of a sketch
BASE = 1009  # more than any number of pivots; lists are numbered in this base
MOST_LISTS, MOST_SHARED = 500, 4
ENTRY, PAIR = 5.0, 0.03  # microseconds that a list entry, and a pair in a list, cost about


class Setting(NamedTuple):
    pivots: int
    prefix: int
    shared: int


EXACT = Setting(0, 0, 0)  # one list for all, if the caller asks for it
PIVOTS = (16, 32, 64, 128, 256, 512)


def usable(v: F.Column) -> F.Column:
    """Not null, not empty, all components finite, not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(vectors: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors of equally long arrays, in double precision."""
    x = np.stack([np.frombuffer(v, dtype=kind) for v in vectors]).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # lengths neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@lru_cache(maxsize=4)
def directions(dim: int, n: int) -> np.ndarray:
    """``n`` random unit vectors, always the same; fewer are the first of more."""
    x = np.random.default_rng(dim).normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest(x: np.ndarray, own: np.ndarray, prefix: int) -> np.ndarray:
    """Numbers of the nearest pivots, in ascending order."""
    return np.sort(np.argsort(-(x @ own.T), axis=1, kind="stable")[:, :prefix], axis=1)


def pairs_at(dim: int, cosine: float, n: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """Random pairs of unit vectors with that cosine."""
    rng = np.random.default_rng([dim, 1])
    x, y = rng.normal(size=(2, n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
    return x, cosine * x + math.sqrt(1 - cosine * cosine) * y


def settings_for(dim: int, n: int, threshold: float, recall: float) -> list[Setting]:
    """For each number of pivots and of shared ones, the shortest prefix that finds ``recall`` of the pairs at the threshold. There is one at least: the fewest pivots, all of them in the prefix."""
    x, y = pairs_at(dim, threshold)
    out = []
    for pivots in PIVOTS[: max(1, sum(16 * k <= n for k in PIVOTS))]:
        own = directions(dim, pivots)
        ranks = [np.argsort(np.argsort(-(v @ own.T), axis=1, kind="stable"), axis=1, kind="stable") for v in (x, y)]
        worse = np.maximum(*ranks)  # a pivot is shared from this prefix on
        for shared in range(2, MOST_SHARED + 1):
            needed = np.sort(worse, axis=1)[:, shared - 1] + 1
            prefix = int(np.sort(needed)[math.ceil(recall * len(needed)) - 1])
            if math.comb(prefix, shared) <= MOST_LISTS:
                out.append(Setting(pivots, prefix, shared))
    return out


def setting(dim: int, n: int, threshold: float, recall: float) -> Setting:
    """The cheapest setting for n vectors."""

    def cost(s: Setting) -> float:
        lists = math.comb(s.prefix, s.shared)
        return lists * ENTRY + lists * lists * n / math.comb(s.pivots, s.shared) * PAIR

    return min(settings_for(dim, n, threshold, recall), key=cost)


def most_differing(threshold: float) -> int:
    """Sketch bits in which a pair may differ: six standard deviations above the mean at the threshold."""
    p = math.acos(threshold) / math.pi
    return min(BITS, math.ceil(BITS * p + 6 * math.sqrt(BITS * p * (1 - p))))


def index(chosen: dict[int, Setting], kind: str):
    """For each member its prefix, its sketch and its lists."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.free()
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                vectors = column(batch, "vector").to_pylist()
                sizes = np.array([len(v) // np.dtype(kind).itemsize for v in vectors], dtype=np.int64)
                for dim in np.unique(sizes).tolist():
                    at = np.flatnonzero(sizes == dim)
                    x, s = matrix([vectors[k] for k in at], kind), chosen[dim]
                    near = nearest(x, directions(dim, s.pivots), s.prefix) if s.pivots else np.zeros((len(at), 0), dtype=np.int64)
                    bits = np.packbits(x @ directions(dim, BITS).T > 0, axis=1)
                    combos = list(combinations(range(s.prefix), s.shared))
                    lists = np.full((len(at), len(combos)), dim * BASE ** (MOST_SHARED - s.shared), dtype=np.int64)
                    for c, combo in enumerate(combos):
                        for p in combo:
                            lists[:, c] = lists[:, c] * BASE + near[:, p] + 1
                    rows = pa.array(np.repeat(np.arange(len(at)), len(combos)))
                    cols = [column(batch, "member").take(pa.array(at)), pa.array([r.tobytes() for r in near.astype(np.uint16)], pa.binary()), pa.array([r.tobytes() for r in bits], pa.binary())]
                    yield pa.RecordBatch.from_arrays([pa.array(lists.reshape(-1)), *(c.take(rows) for c in cols), pa.array(np.full(len(rows), dim, dtype=np.int32))], names=["bucket", "member", "prefix", "sketch", "dim"])

    return run


def owned(bucket: int, s: Setting, rows: pa.Table, low: int, high: int) -> np.ndarray:
    """Which pairs this unit has to look at, as a matrix above the diagonal or between its chunks: those that no earlier list has."""
    n, chunk = rows.num_rows, rows.column("chunk").to_numpy()
    if low == high:
        mine = np.triu(np.ones((n, n), dtype=bool), 1)
    else:
        mine = (chunk == low)[:, None] & (chunk == high)[None, :]
    if s.shared:
        last = bucket % BASE - 1  # the largest pivot of the list's combination
        has = np.zeros((n, s.pivots), dtype=np.float32)
        np.put_along_axis(has, np.frombuffer(b"".join(rows.column("prefix").to_pylist()), dtype=np.uint16).reshape(n, -1).astype(np.int64), 1, axis=1)
        has = has[:, : last + 1]
        # shared pivots up to there: just the combination itself, else an earlier list has the pair
        mine &= has @ has.T == s.shared
    return mine


def candidates(chosen: dict[int, Setting], bits: int):
    """For each unit the members of which a pair is left after the sketches."""

    def work(unit: tuple, rows: pa.Table) -> pa.RecordBatch | None:
        bucket, low, high = unit
        s = chosen[rows.column("dim")[0].as_py()]
        signs = np.unpackbits(np.frombuffer(b"".join(rows.column("sketch").to_pylist()), dtype=np.uint8).reshape(rows.num_rows, -1), axis=1).astype(np.float32) * 2 - 1
        close = signs @ signs.T >= BITS - 2 * bits
        np.fill_diagonal(close, False)
        if not close.any():
            return None
        close &= owned(bucket, s, rows, low, high)
        needed = np.flatnonzero(close.any(axis=0) | close.any(axis=1))
        if not len(needed):
            return None
        own = rows.take(pa.array(needed)).select([*UNIT, "chunk", "member", "prefix", "dim"])
        return own.combine_chunks().to_batches()[0]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.free()
        return each_unit(batches, work)

    return run


def verify(chosen: dict[int, Setting], threshold: float, kind: str):
    def work(unit: tuple, rows: pa.Table) -> pa.RecordBatch | None:
        bucket, low, high = unit
        x = matrix(rows.column("vector").to_pylist(), kind)
        good = x @ x.T >= threshold
        good &= owned(bucket, chosen[rows.column("dim")[0].as_py()], rows, low, high)
        i, j = np.nonzero(good)
        if not len(i):
            return None
        copies, members = rows.column("copies").to_numpy(), rows.column("member").to_numpy()
        links = np.bincount(i, copies[j], rows.num_rows) + np.bincount(j, copies[i], rows.num_rows)
        order = np.argsort(members)
        rank = np.argsort(order)
        root = forest(rows.num_rows, rank[i], rank[j])
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(members[some]), pa.array(links[some].astype(np.int64)), pa.array(members[order[root[rank[some]]]])], names=["member", "links", "root"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.free()
        return each_unit(batches, work)

    return run


def embedding_dedup(vectors: DataFrame, vector: str = "embedding", id_col: str = "vec_id", threshold: float = 0.9, recall: float = 0.98, block: int = 512, exact: bool = False) -> DataFrame:
    """Links vectors with a cosine of ``threshold`` or more.

    Returns one row per row: the id, n_links (other vectors linked directly),
    component_id (smallest id reachable, itself included) and kept (id is
    component_id). ``recall`` is that of pairs just at the threshold; pairs above it
    are found more often. Vectors of every length, however few, are found through the index; only with ``exact``
    are all pairs compared, block by block, at a cost that grows with the square of the rows. Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing; vectors of different lengths, long or short, don't link. Repeated
    rows link with each other; null ids come last and a component of null ids only
    has a null component_id. Other columns, labels too, are ignored, whatever their names; an empty table
    gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    own, v = numbered(vectors), F.col(place(vectors, vector))
    single = vectors.schema[vector].dataType.simpleString() == "array<float>"
    kind, number = ("<f4", "float") if single else ("<f8", "double")
    values = F.when(usable(v), F.transform(v, lambda x: x.cast(number) + F.lit(0.0).cast(number)))  # -0.0 is 0.0
    rows = own.select(F.col(place(vectors, id_col)).alias("id"), values.alias("v"))
    fa, fb = fingerprint(F.col("v"))
    rows = scratch.save(rows.select("id", "v", F.when(F.col("v").isNotNull(), fa).alias("fa"), F.when(F.col("v").isNotNull(), fb).alias("fb"), F.monotonically_increasing_id().alias("row")))
    key = ["fa", "fb"]
    groups = scratch.save(rows.filter("v is not null").groupBy(*key).agg(F.count("*").alias("copies"), F.min("row").alias("member"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("head")))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.free()
        for b in batches:
            flat = [np.asarray(x.values, dtype=kind).tobytes() for x in column(b, "v")]
            yield pa.RecordBatch.from_arrays([column(b, "row"), column(b, "copies"), pa.array(flat, pa.binary())], names=["member", "copies", "vector"])

    firsts = rows.select("row", "v").join(groups.select(F.col("member").alias("row"), "copies"), "row")
    members = scratch.save(firsts.mapInArrow(pack, "member long, copies long, vector binary"))
    width = np.dtype(kind).itemsize
    dims = {r.n // width: r["count"] for r in members.groupBy(F.length("vector").alias("n")).count().collect()}  # one row a length
    chosen = {d: EXACT if exact else setting(d, n, threshold, recall) for d, n in dims.items()}

    entries = members.select("member", "vector").mapInArrow(index(chosen, kind), "bucket long, member long, prefix binary, sketch binary, dim int")
    dealt = units(scratch.save(entries), scratch, block)
    found = by_unit(dealt.select(*UNIT, "chunk", "member", "prefix", "sketch", "dim")).mapInArrow(candidates(chosen, most_differing(threshold)), "bucket long, low int, high int, chunk int, member long, prefix binary, dim int")
    found = scratch.save(found)
    links = scratch.save(by_unit(found.join(members, "member")).mapInArrow(verify(chosen, threshold, kind), "member long, links long, root long"))
    scratch.drop(found, members)
    parts = components(links.select(F.col("member").alias("a"), F.col("root").alias("b")), scratch)

    counted = links.groupBy("member").agg(F.sum("links").alias("links"))
    named = groups.join(parts.withColumnRenamed("node", "member"), "member", "left").join(counted, "member", "left")
    named = scratch.save(named.select(*key, F.coalesce("root", "member").alias("root"), "head", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    heads = named.groupBy("root").agg(F.min("head").alias("least"))
    labelled = scratch.save(named.join(heads, "root").select(*key, "n_links", F.col("least.id").alias("component_id")))
    scratch.drop(groups, links, named)
    out = rows.select("id", *key).join(labelled, key, "left")
    component = F.when(F.col("fa").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


#: For vectors with ids of their own, as the table has.
ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), ok AS (
  SELECT * FROM v WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id < b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.9
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(node, root) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node WHERE r.root < e.b
), c AS (
  SELECT node AS vec_id, min(root) AS component_id FROM r GROUP BY node
), n AS (
  SELECT a AS vec_id, count(*) AS n_links FROM e GROUP BY a
)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""
