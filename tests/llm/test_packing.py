import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lodestrata.llm import packing
from lodestrata.llm.queries import packing_tokenizer
from tests_llm_fixtures import corpus

ODD = ["don't stop. I'll go,we're ...", "İstanbul ǅ ﬁne éa ①² x² <|endoftext|> <|startoftext|>hi", "tab\tsep nbsp", "日本語テキスト。 混合text", "A.B.C., x., ,. ..", "naïve café\r\nnew\x0bline", "123 4,567.89 $5 50% a1b2", "ΣΑΣ ΟΔΟΣ. straße.", "́start"]


def ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing_tokenizer())
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_cache_gives_the_tokenizers_ids():
    texts = ODD + [t or "" for _, t in corpus()]
    for most in (400_000, 50):
        cache = packing.WordCache(packing_tokenizer(), most)
        got = [np.frombuffer(b, dtype="<u4").tolist() for k in range(0, len(texts), 7) for b in cache.encode(texts[k : k + 7])]
        assert cache.short and got == ids(texts)


def layout(plan, histogram, capacity):
    """(bin, offset, length) of every planned piece."""
    out = []
    for n, runs in plan.runs.items():
        ends = [r[0] for r in runs[1:]] + [histogram[n]]
        for (start, per_bin, first, base), end in zip(runs, ends, strict=True):
            out += [(first + k // per_bin, base + k % per_bin * n, n) for k in range(end - start)]
    return out


@pytest.mark.parametrize("seed", range(30))
def test_plans_are_gapless_and_tight(seed):
    rng = random.Random(seed)
    capacity = rng.choice([12, 50, 100])
    histogram = Counter(rng.randint(1, capacity - 1) for _ in range(rng.randint(1, 200)))
    plan = packing.plan_bins(dict(histogram), capacity)
    bins: dict = {}
    for b, offset, n in sorted(layout(plan, histogram, capacity)):
        assert offset == bins.get(b, 0)
        bins[b] = offset + n
    assert max(bins.values()) <= capacity and len(bins) == plan.bins
    large = [n for n in histogram.elements() if 3 * n > capacity]
    assert plan.bins <= max(np.ceil(sum(n * c for n, c in histogram.items()) / capacity) * 1.25 + 2, len(large))


def test_large_items_pair_as_often_as_possible():
    rng = random.Random(3)
    for _ in range(50):
        sizes = [rng.randint(34, 99) for _ in range(rng.randint(1, 9))]
        plan = packing.plan_bins(dict(Counter(sizes)), 100)

        def most(left):
            if len(left) < 2:
                return 0
            a, rest = left[0], left[1:]
            return max([most(rest)] + [1 + most(rest[:k] + rest[k + 1 :]) for k, b in enumerate(rest) if a + b <= 100])

        assert plan.bins == len(sizes) - most(sizes)


def test_documents(documents):
    rows = corpus() + [(900 + k, t) for k, t in enumerate(ODD)]
    capacity = 256
    got = packing.pack_documents(documents(rows), packing_tokenizer, capacity, keep_ids=True).collect()
    want = Counter()
    for (doc, _), own in zip(rows, ids([t for _, t in rows]), strict=True):
        own = np.asarray([*own, 1], dtype="<u4")
        for p, low in enumerate(range(0, len(own), capacity)):
            part = own[low : low + capacity]
            want[doc, p, low, len(part), zlib.crc32(part.tobytes()), tuple(part.tolist())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got) == want
    ends: dict = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= capacity and len(ends) <= sum(r.length for r in got) / capacity + 2


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, ""), (1, "")]])
def test_small_tables(documents, rows):
    got = packing.pack_documents(documents(rows), packing_tokenizer).collect()
    assert [(r.length, r.start) for r in got] == [(1, 0)] * len(rows) and len({(r.sequence_id, r.offset) for r in got}) == len(rows)
