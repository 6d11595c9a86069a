import hashlib
import random
import re
from collections import Counter

import pytest

from lodestrata.llm.substring_dedup import COVER, PERIOD, substring_dedup
from tests_llm_fixtures import corpus, text

WINDOW = 35


def brute(rows):
    own = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[k : k + WINDOW]) for w in own for k in range(len(w) - WINDOW + 1))
    out = []
    for (doc, _), w in zip(rows, own, strict=True):
        gone = set()
        for k in range(len(w) - WINDOW + 1):
            if seen[tuple(w[k : k + WINDOW])] > 1:
                gone.update(range(k, k + WINDOW))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def test_cover_is_a_difference_cover():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def test_against_brute_force(documents):
    rows = corpus()
    got = sorted((tuple(r) for r in substring_dedup(documents(rows), keep_text=True).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, ""), (2, " \n")], [(1, " ".join(["same"] * 80))], [(1, "a b"), (1, "a b")]])
def test_small_tables(documents, rows):
    got = sorted((tuple(r) for r in substring_dedup(documents(rows), keep_text=True).collect()), key=str)
    assert got == brute(rows)


def test_narrow_windows_are_refused(documents):
    with pytest.raises(ValueError):
        substring_dedup(documents([]), window=10)


def test_words_that_a_power_sum_confuses(documents):
    from test_hashing import thue_morse

    rng = random.Random(12)
    around = text(rng, 40).split(" ")
    rows = [(k, " ".join([*around[:20], w, *around[20:]])) for k, w in enumerate(thue_morse(10))]
    assert [(r.n_words, r.n_removed) for r in substring_dedup(documents(rows)).collect()] == [(41, 0), (41, 0)]
