import random

import numpy as np
import pytest

from lodestrata.llm import language_id as D
from lodestrata.llm.queries import language_pieces
from tests_llm_fixtures import text


def brute(word, probs):
    """Sum over all segmentations, by recursion; a letter without a piece has the unknown letter's probability."""
    if not word:
        return 1.0
    total = 0.0
    for k in range(1, len(word) + 1):
        p = probs.get(word[:k], probs["?"] if k == 1 else None)
        if p is not None:
            total += p * brute(word[k:], probs)
    return total


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(1)
    pieces = ["▁", "▁a", "a", "b", "ab", "abc", "c", "ca", "▁ab"]
    probs = rng.random((len(pieces) + 1, 2))
    model = D.Model(["x", "y"], pieces, probs)
    words = ["a", "abc", "abcabc", "cab", "zab", "bbbbbbbb"]
    got = model.word_scores(words)
    for column in (0, 1):
        table = dict(zip(pieces, probs[:, column], strict=False)) | {"?": probs[-1, column]}
        assert np.allclose(got[:, column], [np.log(brute("▁" + w, table)) for w in words])


def test_the_query_against_its_definition(documents):
    """Languages and posteriors worked out word by word, by recursion over all segmentations, from the model that the same sample gives."""
    rng = random.Random(12)
    rows = [(k, text(rng, rng.randint(1, 12), lang), lang) for k, lang in enumerate(["en", "fr", "de"] * 20)] + [(80, "3 -- 4", "en"), (81, None, "fr"), (82, "l’eau É", None)]
    pieces = [p for p in language_pieces() if len(p) <= 6]
    docs = documents(rows)
    model = D.fit(docs, pieces)
    assert model.languages == ["de", "en", "fr"]
    got = {r.doc_id: r for r in D.identify(docs, pieces).collect()}
    for doc, t, _ in rows:
        words = D.words_of(t) if t else []
        if not any(c.isalpha() for c in t or ""):
            assert (got[doc].lang_pred, got[doc].score) == ("und", 0.0)
            continue
        logs = np.array([sum(np.log(brute("▁" + w, dict(zip(pieces, model.probs[:, c], strict=False)) | {"?": model.probs[-1, c]})) for w in words) for c in range(3)])
        assert got[doc].lang_pred == model.languages[int(np.argmax(logs))]
        assert got[doc].score == pytest.approx(1 / np.exp(logs - logs.max()).sum(), abs=1e-6)


def test_rare_languages_are_learned(documents):
    """More classes than any bound on rows leaves room for, one of them with a single text."""
    rng = random.Random(13)
    rows = [(k, " ".join("ab"[k % 2] * rng.randint(2, 5) for _ in range(9)), f"l{k % 230:03d}") for k in range(690)] + [(9000, "zzq qzz zqz " * 4, "rare"), (9500, "zqz zzq", None)]
    docs = documents(rows)
    texts, langs = D.sample(docs, "text", "doc_id", "lang", 2, 400)
    held = {r.doc_id for r in docs.filter(D.held_out()).select("doc_id").collect()}
    assert set(langs) == {lang for k, _, lang in rows if lang and k not in held}
    assert 9000 not in held and {r.doc_id: r.lang_pred for r in D.identify(docs, [p for p in language_pieces() if len(p) <= 3], per_language=1, max_bytes=400).collect()}[9500] == "rare"


def test_training_raises_the_likelihood():
    rng = random.Random(2)
    texts = [text(rng, 50, "fr") for _ in range(10)]
    pieces = language_pieces()
    scores = [D.train(texts, ["fr"] * 10, pieces, rounds=n).scores([D.words_of(t) for t in texts]).sum() for n in (1, 3)]
    assert scores[1] > scores[0]


def test_cache_doesnt_change_scores():
    rng = random.Random(3)
    texts = [text(rng, 30, lang) for lang in ("en", "fr", "de") for _ in range(5)]
    model = D.train(texts, ["a"] * 5 + ["b"] * 5 + ["c"] * 5, language_pieces())
    words = [D.words_of(t) for t in texts]
    whole = model.scores(words)
    small = D.Model(model.languages, model.pieces, model.probs, cache_bytes=2000)
    assert np.allclose(whole, np.concatenate([small.scores([w]) for w in words]))


def test_held_out_accuracy(documents):
    rng = random.Random(4)
    rows = [(k, text(rng, rng.randint(5, 60), lang), lang) for k, lang in enumerate(["en", "fr", "de"] * 60)]
    docs = documents([*rows, (700, None, "en"), (701, "", "en"), (702, "12 -- 5", "fr"), (703, "x" * 20_001, None), (None, rows[0][1], None), (0, rows[0][1], "en")])
    got = D.identify(docs, language_pieces()).collect()
    want = {k: lang for k, _, lang in rows}
    held = [(r.lang_pred, want[r.doc_id]) for r in got if r.held_out and r.doc_id in want]
    assert len(held) > 20 and np.mean([a == b for a, b in held]) > 0.95
    odd = [r for r in got if r.doc_id in (700, 701, 702)]
    assert all(r.lang_pred == "und" and r.score == 0 for r in odd) and len(got) == len(rows) + 6
    assert all(0 <= r.score <= 1 for r in got)


@pytest.mark.parametrize("rows", [[], [(1, "word", None)], [(1, None, "en")]])
def test_without_labels(documents, rows):
    got = D.identify(documents(rows), language_pieces()).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)] * len(rows)


@pytest.fixture(scope="module")
def trained():
    rng = random.Random(6)
    langs = ["de", "en", "fr"]
    texts = [(text(rng, 40 + 30 * k, lang), lang) for k, lang in enumerate(langs) for _ in range(20)]
    return D.train([t for t, _ in texts], [lang for _, lang in texts], language_pieces())


def test_long_words_are_summed_alike(trained):
    rng = random.Random(7)
    words = ["".join(words_in(rng, 30))[:n] for n in (47, 48)]
    trained.word_scores(words[:1])
    for w in words:
        assert np.allclose(trained._long(D.MARK + w), trained.word_scores([w])[0])
    parts = np.concatenate(list(trained.lattice.stretches(words[0], 7)))
    assert np.array_equal(parts, next(trained.lattice.stretches(words[0])))


def words_in(rng, n):
    return text(rng, n, "fr").lower().replace(".", "").split()


@pytest.mark.parametrize("odd", ["語" * 48, "語" * 5000, "жшщыэ" * 20, "ไทย" * 40, "x" * 20_000, "語 " * 300])
def test_unseen_letters_speak_for_no_language(trained, odd):
    rng = random.Random(8)
    for lang in ("de", "en", "fr"):
        plain = text(rng, 12, lang)
        (before, after), scores = trained.judge([plain, f"{plain} {odd}"])
        assert all(0 <= s <= 1 for s in scores)
        if "x" not in odd:
            assert before == after == lang and scores[1] > 0.9
    (_,), (alone,) = trained.judge([odd])
    assert 0 <= alone <= 1 and ("x" in odd or alone < 0.5)


def test_sample_is_bounded_and_the_same_for_all_partitions(documents):
    rng = random.Random(9)
    rows = [(k, text(rng, 8, "en"), "en") for k in range(300)] + [(1000 + k, "the same text", "en") for k in range(200)] + [(2000 + k, text(rng, 8, "fr"), f"l{k % 7}") for k in range(70)]
    docs = documents(rows)
    got = D.sample(docs, "text", "doc_id", "lang", 20, 1 << 20)
    assert got == D.sample(docs.repartition(5), "text", "doc_id", "lang", 20, 1 << 20)
    assert got[1].count("en") == 20 and set(got[1]) == {"en", *(f"l{k}" for k in range(7))} and len(set(got[0])) == len(got[0])
    assert sum(len(t) for t in D.sample(docs, "text", "doc_id", "lang", 20, 2000)[0]) <= 2000


def test_certain_keeps_columns_of_any_name(documents):
    rng = random.Random(10)
    rows = [(k, text(rng, 30, lang), lang) for k, lang in enumerate(["en", "fr", "de"] * 20)] + [(900, None, "en"), (901, "12", "en"), (901, "12", "en")]
    docs = documents(rows, _lang_pred="a", _score=1.0, c0=3, c1="x")
    kept = D.certain(docs, language_pieces(), 0.5)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == list(range(60))
    assert all(r._lang_pred == "a" and r.lang_pred == "zz" and r.score == 0.5 and r.c0 == 3 for r in kept.collect())
    assert D.certain(docs.limit(0), language_pieces(), 0.5).count() == 0
