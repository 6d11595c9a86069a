import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest

from lodestrata.llm import periodic_runs as pr, queries
from tests_llm_fixtures import corpus, words

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(seq, least=12):
    """By definition: for each period the stretches in which words that far apart agree; the smallest period of a stretch counts."""
    number = {}
    w = np.array([number.setdefault(x, len(number)) for x in seq], dtype=np.int64)
    found = {}
    for q in range(1, len(w) // 2 + 1):
        step = np.diff(np.concatenate([[0], (w[:-q] == w[q:]).astype(int), [0]]))
        for s, e in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True):
            if e + q - s >= max(least, 2 * q):
                found.setdefault((s, e + q), q)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def cases(seed):
    rng = random.Random(seed)
    n, k = rng.randint(0, rng.choice([15, 40, 120, 300])), rng.choice([1, 2, 2, 3, 5, 30])
    w = [rng.randrange(k) for _ in range(n)]
    yield w
    if n > 5:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randint(2, 10)
        yield [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    unit, out = [rng.randrange(k) for _ in range(rng.randint(1, 6))], []
    while len(out) < n:
        out += unit * rng.randint(1, 8) + [rng.randrange(k + 1)]
    yield out
    a, b = [0], [1]
    while len(b) < n:
        a, b = b, b + a
    yield b[:n]
    for _ in range(3):
        if n > 12:
            at, m = rng.randrange(n), rng.randint(1, 20)
            w[at:at] = w[at : at + m]
    yield w


@pytest.mark.parametrize("seed", range(120))
def test_all_runs_are_found(seed):
    for w in cases(seed):
        assert pr.runs_of(w) == brute(w), w
        assert pr.runs_of(w, 20) == brute(w, 20), w


@pytest.mark.parametrize("w", [[0] * 5000, ([0] * 99 + [1]) * 12, ([0, 1] * 40 + [2]) * 12, ([0, 1] * 200 + [0, 0] + [1, 0] * 200) * 2, list(range(700)) * 4, [0] * 500 + list(range(1, 300)) + [0] * 500 + list(range(1, 300))])
def test_runs_within_runs(w):
    assert pr.runs_of(w) == brute(w)


def test_short_runs_are_refused():
    with pytest.raises(ValueError):
        pr.runs_of([1, 2], 11)


def contract(doc, text):
    seq = WORD.findall(text or "")
    n = len(seq)
    if doc is not None and n:
        h = zlib.crc32(str(doc).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            seq = [x if i < a else seq[a + (i - a) % p] for i, x in enumerate(seq)]
    runs = brute(seq)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if runs else None
    return doc, len(runs), *best, milli, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(seq) if i not in dropped))


def test_documents(documents):
    rng = random.Random(2)
    own = corpus()
    line = " ".join(words(rng, 7))
    rows = [(d, t) for d, t, *_ in own] + [(500, "\n".join([line] * 9)), (501, "a\x0bb\x0c" * 20), (502, "a b\x85c " * 13), (503, "é " * 12), (504, "é " * 11), (505, "\x1ca " * 30)]
    rows += [(600 + k, " ".join(words(rng, 40))) for k in range(60)] + [(700, " ".join(words(rng, 50_000)) + (" " + line) * 200)]
    got = pr.digests(pr.periodic_runs(pr.with_planted_periods(documents(rows))))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    found = sorted((tuple(r) for r in got.collect() if r.doc_id != 700), key=str)
    assert found == sorted((contract(*r) for r in rows if r[0] != 700), key=str)
    assert any(r[1] and r[0] and 600 <= r[0] < 660 for r in found)
    whole = pr.periodic_runs(documents(rows)).filter("doc_id = 700").first()
    assert [tuple(r) for r in whole.runs if r.period == 7][-1][1] >= 1400 and whole.n_words == 51_400


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, ""), (1, ""), (None, " \t")]])
def test_small_tables(documents, rows):
    got = pr.periodic_runs(pr.with_planted_periods(documents(rows))).collect()
    assert [(r.n_words, r.runs, r.collapsed) for r in got] == [(0, [], "")] * len(rows)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_query_by_definition(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = queries.op12_periodic_runs(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got)) == sorted(contract(r.doc_id, r.text) for r in rows)
