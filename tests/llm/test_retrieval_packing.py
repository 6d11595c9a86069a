import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lodestrata.llm import retrieval_packing as rp
from lodestrata.llm.queries import packing_tokenizer, retrieval_tokenizer
from tests_llm_fixtures import corpus, text, words

ALPHABET = [" ", " ", " ", "\n", "\n", "\t", "\r\n", "\x1c", "\x85", " ", "　", "a", "b", "the", "don't", "I'll", "'s", "É", "straße", "日本", "1", "23", "²", ".", ",", "!?", "(", "😀", "́", "ﬁ", "ǅ", "<|endoftext|>", "_", "-", "ŉ", "'"]


def whole_ids(texts, path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("seed", range(4))
def test_both_libraries_give_the_same_ids(seed):
    rng = random.Random(seed)
    own = rp.ByteTokens(retrieval_tokenizer())
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    assert own.fast and [own.ids(t) for t in texts] == whole_ids(texts, retrieval_tokenizer())


@pytest.mark.parametrize("seed", range(6))
def test_batches_of_texts_give_the_same_ids(seed):
    rng = random.Random(seed)
    own = rp.ByteTokens(retrieval_tokenizer())
    # every other seed without white space but single spaces, so that few texts are worked out by themselves
    alphabet = ALPHABET if seed % 2 else [c for c in ALPHABET if not c.isspace()] + [" "] * 6
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(2000)] + [None, "", " ", "  ", "a ", "a\n", " a b", "a b\n", "a <|endoftext|> b", "b <|endoftext|>"]
    rng.shuffle(texts)
    for kind in (pa.string(), pa.large_string()):
        got = own.arrays(pa.array(texts, kind), (7,))
        assert [x.tolist() for x in got] == [[*ids, 7] for ids in whole_ids(texts, retrieval_tokenizer())]
    assert own.arrays(pa.array([], pa.string()), (7,)) == []


def test_a_word_of_many_texts_is_tokenised_once():
    rng = random.Random(5)
    own = rp.ByteTokens(retrieval_tokenizer())
    vocabulary = words(rng, 50)
    texts = [" ".join(rng.choice(vocabulary) for _ in range(100)) for _ in range(200)]
    want, given = whole_ids(texts, retrieval_tokenizer()), []

    class Counting:
        def __init__(self, fast):
            self.fast = fast

        def encode_ordinary(self, text):
            given.append(len(text))
            return self.fast.encode_ordinary(text)

    own.fast = [Counting(f) for f in own.fast]
    assert [x.tolist() for x in own.arrays(pa.array(texts))] == want
    assert sum(given) < 0.05 * sum(map(len, texts))


def test_another_kind_of_tokenizer_is_used_as_it_is():
    own = rp.ByteTokens(packing_tokenizer())
    assert not own.fast and own.ids("Some words here") == whole_ids(["Some words here"], packing_tokenizer())[0]


def table(docs):
    """Items of a shard from lists of term numbers."""
    counted = [np.unique(np.array(d, dtype=np.int64), return_counts=True) for d in docs]
    return pa.table({"length": pa.array([len(d) for d in docs], pa.int64()), "doc_tokens": pa.array([len(d) for d in docs], pa.int64()), "terms": pa.array([t.astype("<u2").tobytes() for t, _ in counted], pa.binary()), "counts": pa.array([c.astype("<u2").tobytes() for _, c in counted], pa.binary())})


@pytest.mark.parametrize("seed", range(10))
def test_scores_are_bm25(seed):
    rng = random.Random(seed)
    docs = [[rng.randrange(40) for _ in range(rng.randint(1, 30))] for _ in range(rng.randint(2, 25))]
    n, average = len(docs), sum(map(len, docs)) / len(docs)
    often = Counter(t for d in docs for t in set(d))
    stats = rp.Statistics({**often, rp.DOCS: n, rp.TOKENS: sum(map(len, docs))})
    shard = rp.Shard(table(docs), stats)
    for q, query in enumerate(docs):
        want = [sum(max(0.0, math.log((n - often[t] + 0.5) / (often[t] + 0.5))) * d.count(t) * 2.2 / (d.count(t) + 1.2 * (0.25 + 0.75 * len(d) / average)) for t in set(query) if t in d) for d in docs]
        assert np.allclose(shard.scores(q), want, rtol=1e-4, atol=1e-5)


@pytest.mark.parametrize("seed", range(20))
def test_windows_hold_every_token_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([16, 64, 128])
    docs = [[rng.randrange(30) for _ in range(rng.randint(1, capacity - 1))] for _ in range(rng.randint(1, 40))]
    stats = rp.Statistics({**Counter(t for d in docs for t in set(d)), rp.DOCS: len(docs), rp.TOKENS: sum(map(len, docs))})
    windows = list(rp.Shard(table(docs), stats).windows(capacity))
    spans = defaultdict(list)
    for k, window in enumerate(windows):
        total = sum(b - a for _, a, b in window)
        assert total == capacity or total.bit_count() == 1 and total < capacity
        for item, a, b in window:
            spans[item].append((a, b))
    for item, doc in enumerate(docs):
        cuts = sorted(spans[item])
        assert cuts[0][0] == 0 and cuts[-1][1] == len(doc) and all(x[1] == y[0] for x, y in zip(cuts, cuts[1:]))


@pytest.mark.parametrize("seed", range(6))
def test_windows_take_the_best_that_fit(seed):
    """Against the rule in plain words, on shards with terms of many items and of few."""
    rng = random.Random(seed)
    docs = [[int(rng.paretovariate(0.6)) % 300 for _ in range(rng.randint(1, 63))] for _ in range(120)]
    stats = rp.Statistics({**Counter(t for d in docs for t in set(d)), rp.DOCS: len(docs), rp.TOKENS: sum(map(len, docs))})
    shard = rp.Shard(table(docs), stats)
    left, seeded = [len(d) for d in docs], None
    for window in shard.windows(64):
        if sum(b - a for _, a, b in window) < 64:
            break
        if seeded is None or not left[seeded]:
            seeded = next(k for k in range(len(docs)) if left[k])
        want, room, cut, score = [(seeded, left[seeded])], 64 - left[seeded], None, shard.scores(seeded)
        left[seeded] = 0
        for k in sorted((k for k in range(len(docs)) if left[k]), key=lambda k: -score[k]):
            if room and left[k] <= room:
                want.append((k, left[k]))
                room -= left[k]
                left[k] = 0
            elif room and cut is None:
                cut = k
        if room:
            want.append((cut, room))
            left[cut] -= room
        assert [(k, b - a) for k, a, b in window] == want
        seeded = cut


def test_a_seed_gets_its_nearest_neighbours():
    rng = random.Random(3)
    docs = [[10 * topic + rng.randrange(10) for _ in range(16)] for topic in range(8) for _ in range(4)]
    order = list(range(len(docs)))
    rng.shuffle(order)
    stats = rp.Statistics({**Counter(t for d in docs for t in set(d)), rp.DOCS: len(docs), rp.TOKENS: 16 * len(docs)})
    for window in rp.Shard(table([docs[k] for k in order]), stats).windows(64):
        assert len({order[item] // 4 for item, _, _ in window}) == 1


def test_buckets_are_dealt_to_bounded_shards():
    first, parts = rp.deal({0: 5, 3: 4, 4: 30, 9: 2, 10: 2}, 10)
    assert [(int(first[b]), int(parts[b])) for b in (0, 3, 4, 9, 10)] == [(0, 1), (0, 1), (1, 3), (4, 1), (4, 1)]


@pytest.mark.parametrize("capacity,weight", [(1024, 400_000), (128, 3000)])
def test_documents(documents, capacity, weight):
    rng = random.Random(8)
    rows = [(d, t) for d, t, *_ in corpus()] + [(900 + k, "".join(rng.choice(ALPHABET) for _ in range(30))) for k in range(40)] + [(2000, text(rng, 20_000))]
    got = rp.pack_by_retrieval(documents(rows), retrieval_tokenizer, capacity, shard_weight=weight, keep_ids=True).collect()
    want = defaultdict(list)
    for (doc, _), own in zip(rows, whole_ids([t for _, t in rows], retrieval_tokenizer()), strict=True):
        want[doc].append([*own, 0])
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    assert pieces.keys() == want.keys()
    for doc, copies in want.items():
        seen = Counter()
        for r in pieces[doc]:
            assert any(r.doc_tokens == len(ids) and zlib.crc32(np.asarray(ids[r.start : r.start + r.length], dtype="<u4").tobytes()) == r.ids_crc32 and (r.ids is None or r.ids == ids[r.start : r.start + r.length]) for ids in copies)
            seen.update(range(r.start, r.start + r.length))
        assert seen == Counter(k for ids in copies for k in range(len(ids)))
    ends: dict = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert all(n == capacity or n < capacity and n.bit_count() == 1 for n in ends.values())


def test_mates_are_related(documents):
    """Texts of four topics, dealt at random: sequences hold one topic far more often than chance has it."""
    rng = random.Random(4)
    topics = [words(rng, 60) for _ in range(4)]
    rows = [(k, " ".join(rng.choice(topics[k % 4]) for _ in range(40))) for k in rng.sample(range(400), 400)]
    got = rp.pack_by_retrieval(documents(rows), retrieval_tokenizer, 512).collect()
    sequences = defaultdict(set)
    for r in got:
        sequences[r.sequence_id].add(r.doc_id % 4)
    assert sum(len(t) == 1 for t in sequences.values()) > 0.8 * len(sequences)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, ""), (1, ""), (None, "")]])
def test_small_tables(documents, rows):
    got = rp.pack_by_retrieval(documents(rows), retrieval_tokenizer).collect()
    assert sum(r.length for r in got) == len(rows) and len({(r.sequence_id, r.offset) for r in got}) == len(rows)
    assert all(r.start == 0 and r.doc_tokens == 1 and r.ids_crc32 == zlib.crc32(bytes(4)) for r in got)
