import random

import numpy as np

from lodestrata.llm import hashing
from tests_llm_fixtures import text


def test_words_and_windows():
    rng = random.Random(3)
    texts = [text(rng, 40).encode(), b"", b"  one\ttwo\x0bthree\r\n", "übung é".encode(), b"one two three"]
    h, off = hashing.hash_words(texts)
    assert off.tolist() == [0, 40, 40, 43, 45, 48]
    assert h[40:43].tolist() == h[45:48].tolist()
    w = hashing.window_hashes(h, 3)
    assert w[40] == w[45] and len(set(w.tolist())) == len(w) - 1


def test_long_texts_are_cut_between_words(monkeypatch):
    t = ("abc defg " * 500).encode()
    whole, _ = hashing.hash_words([t])
    monkeypatch.setattr(hashing, "CHUNK", 64)
    parts, off = hashing.hash_words([t, b"x" * 1000])
    assert off.tolist() == [0, 1000, 1001] and np.array_equal(parts[:1000], whole)


def thue_morse(n):
    """A word of 2**n letters and its complement, which collide in any power sum modulo 2**64."""
    w = "a"
    for _ in range(n):
        w += w.translate(str.maketrans("ab", "ba"))
    return w, w.translate(str.maketrans("ab", "ba"))


def test_words_dont_collide_by_their_structure():
    for n in (5, 8, 11, 13):
        (one, two), _ = hashing.word_hashes([w.encode() for w in thue_morse(n)], 2)
        assert len(set(one.tolist())) == len(set(two.tolist())) == 2
        spaced, _ = hashing.hash_words([" ".join(w).encode() for w in thue_morse(n)])
        whole = hashing.window_hashes(spaced, 2**n)
        assert whole[0] != whole[2**n]


def test_windows_of_all_lengths():
    rng = random.Random(5)
    h, _ = hashing.hash_words([" ".join(rng.choice("xy") for _ in range(300)).encode()])
    for n in range(1, 40):
        w = hashing.window_hashes(h, n)
        assert len(w) == 301 - n
        same = {tuple(h[k : k + n].tolist()): w[k] for k in range(len(w))}
        assert all(same[tuple(h[k : k + n].tolist())] == w[k] for k in range(len(w))) and len(set(w.tolist())) == len(same)


def test_slices_are_bounded_by_bytes():
    import pyarrow as pa

    texts = ["a" * n for n in (5, 1, 1, 30, 2, 2)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    parts = [p.column(0).to_pylist() for p in hashing.slices(batch, "text", 6)]
    assert sum(parts, []) == texts and all(sum(len(t or "") for t in p[:-1]) < 6 for p in parts)
