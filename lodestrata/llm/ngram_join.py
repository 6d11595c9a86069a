"""Word n-gram Jaccard join with Bayesian candidate pruning.

A text's shingles are its runs of five words (a shorter text is one shingle). Texts
with the same set are one class from the start. The sets get MinHash values; sets
that agree on all values of a band meet in a bucket. There pairs are compared a
band at a time, and a pair is dropped as soon as the posterior probability that
its similarity reaches the threshold, given the values seen so far and a uniform
prior, is below the tolerance. What is left is verified on the shingles
themselves. A pair is looked at only in the first band on which it agrees.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import worker
from .columns import fingerprint, numbered, place
from .hashing import U, column, groups_of, hash_words, mix, window_hashes
from .pairs import UNIT, by_unit, components, each_unit, forest, pair_indexes, units
from .scratch import Scratch

ROWS = 4
SIGNATURE = np.uint16


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def shingles(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, off = hash_words(texts)
    windows = window_hashes(words, n)
    out = []
    for a, b in zip(off[:-1], off[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(windows[a : b - n + 1]))
        elif b > a:
            out.append(window_hashes(words[a:b], int(b - a)))
        else:
            out.append(np.zeros(0, dtype=U))
    return out


def set_key(s: np.ndarray) -> bytes:
    """128 bits for a set of shingles."""
    return np.array([mix(s, 3).sum(dtype=U), mix(s, 4).sum(dtype=U)], dtype=U).tobytes()


def least_matches(hashes: int, threshold: float, tolerance: float) -> list[int]:
    """For 1, 2, ... bands: matches below which the posterior falls below the tolerance."""
    out = []
    for k in range(ROWS, hashes + 1, ROWS):
        total, m = 0.0, -1
        while m < k:
            # with a uniform prior, P(similarity >= t | m of k match) = P(Binomial(k + 1, t) <= m)
            step = math.comb(k + 1, m + 1) * threshold ** (m + 1) * (1 - threshold) ** (k - m)
            if total + step >= tolerance:
                break
            total += step
            m += 1
        out.append(m + 1)
    return out


def signatures(n: int, bands: int):
    """Row by row: the key of the shingle set, its size and its MinHash values."""
    a, b = permutations(bands * ROWS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.free()
        for batch in batches:
            for part, texts in groups_of(batch):
                sets = shingles(texts, n)
                full = [k for k, s in enumerate(sets) if len(s)]
                sig = np.zeros((len(sets), bands * ROWS), dtype=SIGNATURE)
                if full:
                    x = (np.concatenate([sets[k] for k in full]) >> U(32)).astype(np.uint32)
                    starts = np.cumsum([0] + [len(sets[k]) for k in full])[:-1]
                    for h in range(bands * ROWS):
                        y = x * a[h] + b[h]
                        y ^= y >> np.uint32(15)
                        # 16 bits of a minimum tell minima apart well enough; equal minima stay equal
                        sig[full, h] = np.minimum.reduceat(y * np.uint32(0x2C1B3C6D), starts).astype(SIGNATURE)
                cols = [column(part, c) for c in ("row", "id", "fa", "fb")]
                cols += [pa.array([set_key(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.tobytes() for s in sig], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["row", "id", "fa", "fb", "set", "size", "sig"])

    return run


def band_entries(bands: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.free()
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                sig = np.frombuffer(b"".join(column(batch, "sig").to_pylist()), dtype=SIGNATURE).reshape(batch.num_rows, bands, ROWS)
                key = np.zeros((batch.num_rows, bands), dtype=U)
                for r in range(ROWS):
                    key = mix(key ^ sig[:, :, r].astype(U))
                key = mix(key ^ np.arange(bands, dtype=U), 7)
                at = pa.array(np.repeat(np.arange(batch.num_rows), bands))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.reshape(-1).view(np.int64)), pa.array(np.tile(np.arange(bands, dtype=np.int32), batch.num_rows)), column(batch, "member").take(at), column(batch, "size").take(at)],
                    names=["bucket", "band", "member", "weight"],
                )

    return run


def survivors(bands: int, threshold: float, tolerance: float):
    """For a unit's rows: the pairs that are left when all values have been compared, band by band."""
    least = least_matches(bands * ROWS, threshold, tolerance)

    def pairs(unit: tuple, rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), dtype=SIGNATURE).reshape(rows.num_rows, -1)
        size, band = rows.column("size").to_numpy(), int(rows.column("band")[0].as_py())
        i, j = pair_indexes(rows.column("chunk").to_numpy(), *unit[1:])
        fits = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-9
        i, j = i[fits], j[fits]
        same = np.zeros(len(i), dtype=np.int32)
        for k in range(bands):
            if not len(i):
                break
            equal = sig[i, k * ROWS] == sig[j, k * ROWS]
            agree = equal.copy()
            now = equal.astype(np.int32)
            for r in range(k * ROWS + 1, (k + 1) * ROWS):
                equal = sig[i, r] == sig[j, r]
                now += equal
                agree &= equal
            same += now
            stay = same >= least[k]
            if k < band:
                stay &= ~agree  # an earlier band has this pair
            i, j, same = i[stay], j[stay], same[stay]
        return i, j

    return pairs


def candidates(bands: int, threshold: float, tolerance: float):
    """For each unit the members of which a pair is left. Pairs aren't written: verification finds them again from the signatures."""
    pairs = survivors(bands, threshold, tolerance)

    def work(unit: tuple, rows: pa.Table) -> pa.RecordBatch | None:
        needed = np.unique(np.concatenate(pairs(unit, rows)))
        if not len(needed):
            return None
        cols = [pa.array(np.full(len(needed), x), t) for x, t in zip(unit, (pa.int64(), pa.int32(), pa.int32()), strict=True)]
        own = [pa.array(rows.column(c).to_numpy()[needed]) for c in ("band", "chunk", "member")]
        return pa.RecordBatch.from_arrays([*cols, *own], names=[*UNIT, "band", "chunk", "member"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.free()
        return each_unit(batches, work)

    return run


def verify(bands: int, threshold: float, tolerance: float):
    """Exact similarities of the pairs that are left; what is written grows with the members."""
    pairs = survivors(bands, threshold, tolerance)

    def work(unit: tuple, rows: pa.Table) -> pa.RecordBatch | None:
        members = rows.column("member").to_numpy()
        if len(firsts := np.unique(members, return_index=True)[1]) < rows.num_rows:
            rows = rows.take(pa.array(np.sort(firsts)))  # the text of a member came from more than one row
            members = rows.column("member").to_numpy()
        i, j = pairs(unit, rows)
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        sets = [np.frombuffer(x, dtype=U) for x in rows.column("shingles").to_pylist()]
        copies = rows.column("copies").to_numpy()
        _, codes = np.unique(np.concatenate(sets), return_inverse=True)
        codes = codes.astype(np.int32)
        sizes = np.array([len(s) for s in sets])
        ends = np.cumsum(sizes)
        own = [codes[b - n : b] for n, b in zip(sizes, ends, strict=True)]
        here = np.zeros(len(codes), dtype=bool)
        good = np.zeros(len(i), dtype=bool)
        cuts = np.flatnonzero(np.diff(i)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(i)], strict=True) if len(i) else []:
            k = i[a]
            here[own[k]] = True
            for c in range(a, b, 64):  # so many partners at a time
                p = j[c : min(b, c + 64)]
                shared = np.add.reduceat(here[np.concatenate([own[x] for x in p])].astype(np.int32), np.cumsum([0] + [sizes[x] for x in p])[:-1])
                good[c : c + len(p)] = shared >= threshold * (sizes[k] + sizes[p] - shared) - 1e-9
            here[own[k]] = False
        i, j = i[good], j[good]
        if not len(i):
            return None
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


def shingle_rows(n: int):
    """The shingles of each member, from one of the rows with its text that a task sees."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.free()
        last = None
        for batch in batches:
            members = column(batch, "member").to_numpy()
            new = np.append(members[:1] != last, members[1:] != members[:-1])  # rows come sorted, copies next to each other
            last = members[-1] if len(members) else last
            for part, texts in groups_of(batch.filter(pa.array(new))):
                yield pa.RecordBatch.from_arrays([column(part, "member"), column(part, "copies"), pa.array([s.tobytes() for s in shingles(texts, n)], pa.binary())], names=["member", "copies", "shingles"])

    return run


def ngram_join(docs: DataFrame, n: int = 5, threshold: float = 0.8, bands: int = 25, tolerance: float = 1e-6, text: str = "text", id_col: str = "doc_id", block: int = 512, load: int = 400_000) -> DataFrame:
    """Links texts whose sets of ``n``-word shingles have a Jaccard similarity of ``threshold`` or more.

    Words are runs of bytes other than space and 0x09-0x0D, unchanged. Returns one
    row per row of ``docs``: the id, class_id (smallest id among all rows reachable
    over links), n_links (other rows linked directly), kept (one row of each class,
    that with the smallest id) and fa and fb, the fingerprint of the text. Null, empty
    and blank texts have no shingles, link with nothing and are classes of their own.
    Repeated rows link with each other; of rows with the same smallest id one is kept.
    Null ids come last; a class of null ids only has a null class_id. Whole texts
    count, however long: a unit of work holds ``load`` shingles a chunk or one text.
    Other columns are ignored, whatever their names; an empty table gives no rows.

    Bands of four values find a pair at the threshold with probability
    1 - (1 - 0.8**4)**25, over 0.999998; pruning drops a pair when the posterior
    probability of reaching the threshold is below ``tolerance``, at most
    ``bands`` * ``tolerance`` of them in all. No bucket is capped. Rows are numbered once, in a
    written table; texts are read again by their id and fingerprint, so a second
    read may be split otherwise.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram")
    kind = docs.schema[id_col].dataType.simpleString()
    own = numbered(docs)
    kept_text = F.coalesce(F.col(place(docs, text)), F.lit(""))
    fa, fb = fingerprint(kept_text)
    base = own.select(F.col(place(docs, id_col)).alias("id"), fa.alias("fa"), fb.alias("fb"), kept_text.alias("text"))
    signed = base.withColumn("row", F.monotonically_increasing_id()).mapInArrow(signatures(n, bands), f"row long, id {kind}, fa long, fb long, set binary, size int, sig binary")
    rows = scratch.save(signed)
    first = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    sets = scratch.save(rows.filter("size > 0").groupBy("set").agg(F.count("*").alias("copies"), F.min("row").alias("member"), F.min_by(F.struct("id", "fa", "fb"), "row").alias("own"), F.min(first).alias("first"), F.any_value("size").alias("size"), F.any_value("sig").alias("sig")))

    entries = sets.select("member", "size", "sig").mapInArrow(band_entries(bands), "bucket long, band int, member long, weight int")
    dealt = units(entries, scratch, block, load).join(sets.select("member", "size", "sig"), "member")
    found = by_unit(dealt.select(*UNIT, "band", "chunk", "member", "size", "sig")).mapInArrow(candidates(bands, threshold, tolerance), "bucket long, low int, high int, band int, chunk int, member long")
    found = scratch.save(found)

    # one text for each set that is to be verified; both sides grow with the input
    wanted = found.select("member").distinct().join(sets.select("member", "copies", "own"), "member").select("member", "copies", F.col("own.id").alias("_id"), F.col("own.fa").alias("_fa"), F.col("own.fb").alias("_fb"))
    same = (F.col("fa") == F.col("_fa")) & (F.col("fb") == F.col("_fb")) & F.col("id").eqNullSafe(F.col("_id"))
    texts = base.join(wanted.hint("merge"), same).select("member", "copies", "text")
    ready = texts.mapInArrow(shingle_rows(n), "member long, copies long, shingles binary")
    both = found.join(sets.select("member", "size", "sig"), "member").join(ready, "member")
    links = scratch.save(by_unit(both).mapInArrow(verify(bands, threshold, tolerance), "member long, links long, root long"))
    scratch.drop(found)

    classes = components(links.select(F.col("member").alias("a"), F.col("root").alias("b")), scratch)
    counted = links.groupBy("member").agg(F.sum("links").alias("links"))
    named = sets.select("set", "member", "copies", "first").join(classes.withColumnRenamed("node", "member"), "member", "left").join(counted, "member", "left").withColumn("root", F.coalesce("root", "member"))
    named = scratch.save(named.select("set", "root", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    heads = named.groupBy("root").agg(F.min("first").alias("head"))
    labelled = scratch.save(named.join(heads, "root").select("set", "n_links", F.col("head.id").alias("class_id"), F.col("head.row").alias("head_row")))
    scratch.drop(sets, links, named)
    out = rows.select("row", "id", "fa", "fb", "set", "size").join(labelled, "set", "left")
    empty = F.col("size") == 0
    return out.select(
        F.col("id").alias(id_col), F.when(empty, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.when(empty, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"), (empty | (F.col("row") == F.col("head_row"))).alias("kept"), "fa", "fb"
    )


def one_of_each(docs: DataFrame, text: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """One row of ``docs`` of each class of the n-gram join, that with the smallest id, with all its columns.

    Texts without shingles are classes of their own and stay. Of rows with the same
    id and text one stays, whichever; null ids and an empty table are no trouble.
    """
    scratch = Scratch(docs.sparkSession, "distinct")
    seen = ngram_join(docs, text=text, id_col=id_col, **options)
    key = ["_id", "_fa", "_fb"]
    seen = seen.select(F.col(id_col).alias("_id"), F.col("fa").alias("_fa"), F.col("fb").alias("_fb"), F.col("kept").cast("int").alias("k"))
    kept = scratch.save(seen.groupBy(*key).agg(F.count("*").alias("n"), F.sum("k").alias("k")).filter("k > 0").select(*key, (F.col("n") > F.col("k")).alias("repeated")))
    own = numbered(docs)
    t = F.coalesce(F.col(place(docs, text)), F.lit(""))
    fa, fb = fingerprint(t)
    same = F.col(place(docs, id_col)).eqNullSafe(F.col("_id")) & (fa == F.col("_fa")) & (fb == F.col("_fb"))
    out = own.join(kept.filter("not repeated"), same, "left_semi")
    if kept.filter("repeated").limit(1).count():
        several = own.join(kept.filter("repeated"), same)
        # repeated rows may differ in other columns: the first that the shuffle brings stays
        out = out.unionByName(several.dropDuplicates(key).select(*own.columns))
    return out.toDF(*docs.columns)


#: For documents with ids of their own, as the table has.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p + 4], ' '))) END AS s FROM d
), x AS (
  SELECT doc_id, unnest(s) AS t FROM g
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM x a JOIN x b USING (t) WHERE a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN g ga ON ga.doc_id = a JOIN g gb ON gb.doc_id = b WHERE n >= CAST(0.8 AS DOUBLE) * (len(ga.s) + len(gb.s) - n) - 1e-9
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(node, root) AS (
  SELECT doc_id, doc_id FROM g UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node WHERE r.root < e.b
), c AS (
  SELECT node AS doc_id, min(root) AS class_id FROM r GROUP BY node
), n AS (
  SELECT a AS doc_id, count(*) AS n_links FROM e GROUP BY a
)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, doc_id = class_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
