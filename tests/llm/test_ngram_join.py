import random
from collections import Counter

import numpy as np
import pytest
from scipy_free import posterior

from lodestrata.llm import ngram_join as N
from tests_llm_fixtures import changed, corpus, text


def sets_of(rows):
    out = []
    for _, t in rows:
        w = (t or "").replace("\t", " ").replace("\n", " ").split(" ")
        w = [x for x in w if x]
        out.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    return out


def brute(rows):
    sets = sets_of(rows)
    n = len(rows)
    links = [(i, j) for i in range(n) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = list(range(n))
    for _ in range(n):
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    degree = Counter(k for pair in links for k in pair)
    least = {}
    for k, (doc, _) in enumerate(rows):
        key = (doc is None, doc)
        least[root[k]] = min(least.get(root[k], key), key, key=lambda x: (x[0], x[1] or 0))
    return sorted(((doc, least[root[k]][1], degree[k]) for k, (doc, _) in enumerate(rows)), key=str), len(set(root))


@pytest.mark.parametrize("block", [3, 512])
def test_against_brute_force(documents, block):
    rng = random.Random(9)
    base = text(rng, 150)
    rows = corpus() + [(500 + k, changed(rng, base, k % 8)) for k in range(40)]
    got = N.ngram_join(documents(rows), block=block).collect()
    want, classes = brute(rows)
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=str) == want
    assert sum(r.kept for r in got) == classes and all(r.doc_id == r.class_id for r in got if r.kept)


@pytest.mark.parametrize("rows", [[], [(1, None), (2, None)], [(1, ""), (2, "")], [(1, "one two"), (2, "one two"), (3, "two one")], [(None, "a b c d e f"), (None, "a b c d e f")]])
def test_small_tables(documents, rows):
    got = N.ngram_join(documents(rows)).collect()
    want, classes = brute(rows)
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=str) == want and sum(r.kept for r in got) == classes


def test_pruning_is_by_the_posterior():
    for band, least in enumerate(N.least_matches(40, 0.8, 1e-3), 1):
        k = band * N.ROWS
        assert posterior(least, k, 0.8) >= 1e-3 and (least == 0 or posterior(least - 1, k, 0.8) < 1e-3)


def test_signatures_estimate_similarity():
    rng = random.Random(1)
    a = text(rng, 400)
    x, y = (N.shingles([t.encode()], 5)[0] for t in (a, changed(rng, a, 20)))
    mult, add = N.permutations(100)

    def minima(s):
        v = (s >> np.uint64(32)).astype(np.uint32)[:, None] * mult + add
        v ^= v >> np.uint32(15)
        return (v * np.uint32(0x2C1B3C6D)).min(axis=0)

    truth = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    assert abs((minima(x) == minima(y)).mean() - truth) < 0.17


@pytest.mark.parametrize("load", [50, 400_000])
def test_units_are_bounded_by_weight(documents, load):
    rng = random.Random(21)
    base = text(rng, 400)
    rows = [(k, changed(rng, base, k % 9)) for k in range(30)]
    got = N.ngram_join(documents(rows), load=load).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=str) == brute(rows)[0]


@pytest.fixture
def resplit(spark, monkeypatch):
    """Reads of files are split otherwise after each written table, as when executors come and go."""
    from lodestrata.llm.scratch import Scratch

    key, save = "spark.sql.files.minPartitionNum", Scratch.save

    def changing(self, df):
        out = save(self, df)
        spark.conf.set(key, {"4": "2", "2": "7"}.get(spark.conf.get(key), "4"))
        return out

    spark.conf.set(key, "4")
    monkeypatch.setattr(Scratch, "save", changing)
    yield
    spark.conf.unset(key)


def test_reads_may_be_split_otherwise(spark, documents, tmp_path, resplit):
    rng = random.Random(22)
    rows = []
    for k in range(200):
        t = text(rng, 60)
        rows += [(2 * k, t), (2 * k + 1, changed(rng, t, 1))]
    rows += [(1000, rows[0][1]), (1000, rows[0][1]), (None, None), (None, None)]
    documents(rows).repartition(6).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    got = N.ngram_join(docs).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=str) == brute(rows)[0]
    kept = N.one_of_each(docs)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([2 * k for k in range(200)] + [None, None], key=str)


def test_one_of_each_keeps_columns_of_any_name(spark, documents):
    rng = random.Random(23)
    same = text(rng, 30)
    rows = [(3, same), (3, same), (3, same), (5, same), (7, ""), (7, ""), (None, "a b c d e f g"), (None, "a b c d e f g"), (9, "x " * 30_000), (8, "x " * 30_000)]
    docs = documents(rows, _id=1, _row=2, _fa=3, fa=4, fb=5, kept="k", class_id=9, c0=1)
    got = N.one_of_each(docs).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted([3, 7, 7, None, 8], key=str)
    assert all((r._id, r._row, r._fa, r.kept) == (1, 2, 3, "k") for r in got) and N.one_of_each(docs).columns == docs.columns
    assert N.one_of_each(docs.limit(0)).count() == 0
