import numpy as np
import pytest

from lodestrata.llm import embedding_dedup as index_of
from lodestrata.llm.embedding_dedup import embedding_dedup


def table(spark, rows):
    return spark.createDataFrame([(k, None if v is None else [None if x is None else float(x) for x in v], 1, 2, "m") for k, v in rows], "vec_id long, embedding array<float>, label int, row long, member string")


def brute(rows, threshold=0.9):
    good = []
    for k, v in rows:
        x = None if v is None or any(c is None for c in v) else np.float32(v).astype(float)
        good.append((k, x if x is not None and len(x) and np.isfinite(x).all() and x.any() else None))
    n = len(good)
    root, degree = list(range(n)), [0] * n
    links = []
    for i in range(n):
        for j in range(i):
            a, b = good[i][1], good[j][1]
            if a is not None and b is not None and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                links.append((i, j))
                degree[i] += 1
                degree[j] += 1
    for _ in range(n):
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    least = {}
    for k, (doc, _) in enumerate(good):
        least.setdefault(root[k], []).append(doc)
    return sorted(((doc, degree[k], min(least[root[k]], key=lambda x: (x is None, x or 0))) for k, (doc, _) in enumerate(good)), key=str)


def groups(rng, n, size, noise):
    out = []
    for _ in range(n):
        base = rng.normal(size=32)
        out += [base + noise * rng.normal(size=32) for _ in range(size)]
    return out


@pytest.mark.parametrize("block", [16, 512])
def test_near_copies(spark, block):
    rng = np.random.default_rng(1)
    vectors = list(rng.normal(size=(200, 32))) + groups(rng, 6, 12, 0.05)
    vectors += [vectors[0], vectors[0] * 3, vectors[210]]
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    got = embedding_dedup(table(spark, rows), block=block).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_recall_near_the_threshold_and_no_false_link(spark):
    rng = np.random.default_rng(2)
    rows = [(k, v.tolist()) for k, v in enumerate(list(rng.normal(size=(300, 32))) + groups(rng, 60, 3, 0.22))]
    want = {r[0]: r[1] for r in brute(rows)}
    got = {r.vec_id: r.n_links for r in embedding_dedup(table(spark, rows)).collect()}
    assert all(got[k] <= want[k] for k in want)
    assert sum(got.values()) >= 0.9 * sum(want.values())


def test_one_group_with_a_third_of_the_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(k, v.tolist()) for k, v in enumerate(list(rng.normal(size=(600, 32))) + groups(rng, 1, 300, 0.25))]
    want = {r[0]: r[1] for r in brute(rows)}
    got = {r.vec_id: r.n_links for r in embedding_dedup(table(spark, rows)).collect()}
    assert all(got[k] <= want[k] for k in want)
    assert sum(got.values()) >= 0.9 * sum(want.values())


def test_recall_of_the_index_over_many_vectors(spark):
    """2400 vectors, pairs at a cosine just above the threshold among them: links against all pairs."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1200, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    c = np.repeat([0.902, 0.93, 0.97], 400)[:, None]
    v = np.concatenate([x, c * x + np.sqrt(1 - c * c) * y]).astype(np.float32)
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    want = (u @ u.T >= 0.9).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in embedding_dedup(table(spark, [(k, r.tolist()) for k, r in enumerate(v)])).collect()}
    assert all(got[k] <= want[k] for k in range(len(v)))
    found = np.array([got[k] for k in range(1200)])
    assert found[:400].sum() >= 0.95 * want[:400].sum() and found[400:].sum() >= 0.99 * want[400:1200].sum()


def test_small_tables_go_through_the_index():
    for dim in (1, 2, 3, 16, 64):
        for n in (1, 2, 300, 5000):
            s = index_of.setting(dim, n, 0.9, 0.98)
            assert s != index_of.EXACT and s.prefix >= s.shared >= 2


@pytest.mark.parametrize("dim", [1, 2, 3, 5])
def test_short_vectors(spark, dim):
    rng = np.random.default_rng(dim)
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([b + 0.02 * rng.normal(size=(5, dim)) for b in rng.normal(size=(12, dim))]))]
    got = embedding_dedup(table(spark, rows), exact=True).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute(rows)
    want = {r[0]: r[1] for r in brute(rows)}
    found = {r.vec_id: r.n_links for r in embedding_dedup(table(spark, rows)).collect()}
    assert all(found[k] <= want[k] for k in want) and sum(found.values()) >= 0.9 * sum(want.values())


@pytest.mark.parametrize("rows", [[], [(1, None), (2, []), (3, [0, 0]), (4, [None, 1]), (5, [float("nan"), 1]), (6, [float("inf"), 1])], [(1, [1, 0]), (2, [2, 0]), (3, [1, 0, 0]), (1, [1, 0]), (None, [1, 0])]])
def test_odd_vectors(spark, rows):
    got = embedding_dedup(table(spark, rows)).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute(rows)
