import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import toxicity
from tests_llm_fixtures import text

RUDE = ["idiot", "moron", "clown"]


def labelled(rng, n):
    rows = []
    for k in range(n):
        t = text(rng, rng.randint(10, 60))
        toxic = int(k % 4 == 0)
        if toxic:
            w = t.split(" ")
            w.insert(rng.randrange(len(w)), rng.choice(RUDE))
            t = " ".join(w)
        rows.append((k, t, toxic))
    return rows


@pytest.fixture(scope="module")
def scored(spark, documents):
    rows = labelled(random.Random(2), 400)
    docs = documents([(k, t) for k, t, _ in rows] + [(1000, None), (1001, ""), (1002, "..."), (None, "you idiot")])
    labels = spark.createDataFrame([(k, 1, y) for k, _, y in rows] + [(0, 1, None), (0, 1, 1), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    return rows, toxicity.toxicity(docs, labels).collect()


def test_held_out_rows_are_told_apart(scored):
    rows, got = scored
    by = {r.doc_id: r for r in got}
    assert len(got) == 404
    held = [(by[k].score, y) for k, _, y in rows if by[k].held_out]
    pos, neg = ([s for s, y in held if y == v] for v in (1, 0))
    assert np.mean([[a > b for b in neg] for a in pos]) > 0.95
    assert np.mean([(s >= 0.5) == y for s, y in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert by[1000].score == by[1001].score == by[1002].score < 0.5 and not by[None].held_out


def test_offending_sentences_are_found(scored):
    rows, got = scored
    texts = {k: t for k, t, _ in rows}
    for r in got:
        if r.doc_id in texts and r.predicted:
            spans = [tuple(map(int, s.split(":"))) for s in r.sentences.split(",")]
            assert any(w in texts[r.doc_id][a:b].lower() for a, b in spans for w in RUDE)


def test_noisy_or(spark):
    model = toxicity.Model(-2.0, -1.0, {"bad ": 3.0, "sad ": -0.5, "ill ": 1.5})
    leak, bad, sad, ill = (1 / (1 + np.exp(-z)) for z in (-2.0, 2.0, -1.5, 0.5))
    rows = spark.createDataFrame([(1, "fine. bad one! sad. ill\nsad. sad"), (2, "sad. sad. sad")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(rows, model).collect()}
    mild = sad * (1 - 2 * leak) / (1 - leak)
    assert got[1].score == pytest.approx(1 - (1 - leak) * (1 - bad) * (1 - ill) * (1 - mild)) and got[1].sentences == "5:13,19:23"
    assert got[2].score == pytest.approx(1 - (1 - leak) * (1 - mild)) and got[2].sentences == ""


def test_mild_sentences_never_make_a_document_toxic():
    for leak in (-9.0, -2.0, -0.01):
        model = toxicity.Model(leak, -1e-6, {"odd ": 0.0})
        assert model.score("odd. " * 10_000) == (model.score("odd")[0], "") and leak < 0 and model.score("odd")[0] < 0.5


def test_gradient_by_finite_differences():
    rng = random.Random(7)
    rows = labelled(rng, 60)
    bags = [toxicity.bag(t) for _, t, _ in rows]
    y = [v for _, _, v in rows]
    data = toxicity.Bags.of(bags, y, ["idiot ", "moro", "the", "clown "])
    theta = np.array([1.0, 0.4, -0.3, 0.7, -1.2, -2.5])
    value, grad = data.likelihood(theta, 1e-3)
    # the likelihood by its definition
    brute = 0.0
    for own, label in zip(bags, y, strict=True):
        none = 1 - 1 / (1 + np.exp(2.5))
        for words in own:
            z = [w for f, w in zip(["idiot ", "moro", "the", "clown "], theta, strict=False) for x in words for g in toxicity.features(x) if g == f]
            if z:
                none *= 1 - 1 / (1 + np.exp(1.2 - sum(z)))
        brute += np.log(1 - none) if label else np.log(none)
    assert value == pytest.approx(brute / len(y) - 1e-3 * (theta[:4] @ theta[:4]) / 2)
    for k in range(len(theta)):
        step = np.zeros_like(theta)
        step[k] = 1e-6
        assert grad[k] == pytest.approx((data.likelihood(theta + step, 1e-3)[0] - data.likelihood(theta - step, 1e-3)[0]) / 2e-6, abs=1e-6)


def test_the_query_against_the_definition(spark, documents, scored):
    """Scores worked out sentence by sentence, from the model that the same sample gives."""
    rows, got = scored
    usable = sorted((t, y) for k, t, y in rows if not next(r.held_out for r in got if r.doc_id == k))
    docs = documents([(k, t) for k, t, _ in rows])
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    texts, y = toxicity.sample(docs, labels, "text", "doc_id", "toxic", 6000, 1 << 20)
    assert sorted(zip(texts, y, strict=True)) == usable
    model = toxicity.train(texts, y)
    for r in toxicity.toxicity(docs, labels).collect():
        leak = 1 / (1 + np.exp(-model.leak))
        none, mild = 1 - leak, 0.0
        for sentence in re.split(r"[.!?\n]+", dict((k, t) for k, t, _ in rows)[r.doc_id]):
            own = [model.weights[f] for w in re.findall(r"\w+", sentence.lower()) for f in toxicity.features(w) if f in model.weights]
            if own:
                p = 1 / (1 + np.exp(-model.bias - sum(own)))
                none, mild = (none * (1 - p), mild) if p >= 0.5 else (none, max(mild, p))
        none *= 1 - mild * (1 - 2 * leak) / (1 - leak)
        assert r.score == pytest.approx(1 - none, abs=1e-9) and r.predicted == bool(r.sentences)


def test_long_clean_texts_stay_clean(spark, documents):
    rng = random.Random(11)
    rows = labelled(rng, 400)
    docs = documents([(k, t) for k, t, _ in rows] + [(1000, text(rng, 200_000)), (1001, " ".join(text(rng, 12) for _ in range(20_000))), (1002, text(rng, 100_000) + " you idiot. " + text(rng, 1000))])
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert [got[k].predicted for k in (1000, 1001, 1002)] == [0, 0, 1] and got[1002].sentences.count(":") == 1


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the test tables")
def test_joined_clean_texts_of_the_tables_stay_clean(spark):
    """With their real words, of which many tell a little."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(*toxicity.sample(docs, labels, "text", "doc_id", "toxic", 2000, 16 << 20))
    clean = [r.text for r in docs.join(labels.filter("toxic = 0"), "doc_id").orderBy("doc_id").select("text").collect() if r.text and not model.score(r.text)[1]]
    assert len(clean) > 3000
    for n in (100, 1000, len(clean)):
        score, where = model.score("\n".join(clean[:n]))
        assert score < 0.5 and not where


def test_sample_is_bounded(spark, documents):
    rng = random.Random(12)
    rows = labelled(rng, 200)
    docs = documents([(k, t) for k, t, _ in rows] * 3, c0=1, label=2, g=3)
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    texts, y = toxicity.sample(docs, labels, "text", "doc_id", "toxic", 50, 1 << 20)
    assert len(texts) == len(set(texts)) == 50 and set(y) == {0, 1}
    assert (texts, y) == toxicity.sample(docs.repartition(7), labels, "text", "doc_id", "toxic", 50, 1 << 20)


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, 1, None)]])
def test_without_both_labels(spark, documents, labels):
    docs = documents([(1, "a b c"), (2, "d")])
    got = toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == 2 and got[0].score == got[1].score
    assert toxicity.toxicity(docs.filter(F.lit(False)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0
