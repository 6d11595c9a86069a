import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import fill_in_middle as fim
from tests_llm_fixtures import corpus, text

ODD = ["日本語テキスト。 混合text", "😀" * 3000, "a<P>b", "<S>", "x <M", "<", "<S", "é", "́start", "\r\n\t", "P>S>M>", "<<P" * 5]


def brute(doc, text, seed=1, rate=90, spm=20):
    text = text or ""
    n = len(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc, n, "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return doc, n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc, n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("share", [256, 3, 1])
def test_documents(documents, share):
    rng = random.Random(5)
    rows = corpus() + [(1000 + k, t) for k, t in enumerate(ODD)] + [(2000 + k, text(rng, 9)) for k in range(40)]
    rows += [(3000 + k, rows[9][1]) for k in range(30)] + [(4000, text(rng, 60_000)), (4001, None), (4001, None)]
    out = fim.fill_in_middle(documents([(d, t, "en") for d, t, *_ in rows]), share=share)
    got = out.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == Counter(brute(d, t) for d, t, *_ in rows)
    assert Counter((r.doc_id, r.back) for r in got) == Counter((d, t or "") for d, t, *_ in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_other_rates_and_empty_tables(documents):
    rows = [(k, text(random.Random(k), 5)) for k in range(50)]
    got = fim.fill_in_middle(documents(rows), seed=7, rate=50, spm=100).collect()
    assert sorted((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == sorted(brute(d, t, 7, 50, 100) for d, t in rows)
    empty = fim.digests(fim.fill_in_middle(documents([])))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]


@pytest.mark.parametrize("seed", range(20))
def test_lists_select_every_value(seed):
    rng = np.random.default_rng(seed)
    universe = int(rng.integers(1, 20_000))
    values = np.sort(rng.choice(universe, int(rng.integers(1, universe + 1)), replace=False))
    coded = fim.elias_fano(values, universe)
    assert [fim.select(coded, k) for k in range(len(values) + 1)] == [*values.tolist(), universe]
    assert fim.select(fim.elias_fano(values[:0], 0), 0) == 0


def test_a_plain_text_takes_about_two_bits_a_character():
    assert len(fim.boundary_list("x" * 100_000)) < 26_000
