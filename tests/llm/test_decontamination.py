import random

import pytest
import regex

from lodestrata.llm import decontamination as D
from lodestrata.llm.decontamination import decontaminate, matches
from tests_llm_fixtures import text, words

ITEM = "a train leaves the old station at 15 km per hour and passes Paris after 3 hours with 120 people aboard it"


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_plain_and_changed_copies(spark, documents):
    rng = random.Random(4)
    plain = [text(rng, 120) for _ in range(5)]
    other = ITEM.replace("15", "47").replace("Paris", "Berlin").replace("120", "999")
    docs = documents([(0, f"{plain[0]} {ITEM} {plain[1]}"), (1, f"{plain[1]} {other} {plain[2]}"), (2, plain[3]), (3, None), (4, ""), (5, ITEM.upper()), (6, f"{plain[4]}\n\n{ITEM}"), (6, f"{plain[4]}\n\n{ITEM}"), (None, ITEM)])
    got = {(r.doc_id, r.item_id): r for r in matches(docs, items(spark, [(7, ITEM), (8, text(rng, 40)), (9, ITEM), (10, None), (11, "short")])).collect()}
    assert {k for k, _ in got} == {0, 1, 5, 6, None}
    assert got[0, 7].changed == 0 and got[1, 7].changed == 3 and got[0, 7].n_items == 2
    kept = decontaminate(docs, items(spark, [(7, ITEM)]))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4] and kept.columns == docs.columns


def test_inconsistent_slots_are_no_match(spark, documents):
    item = "give 5 apples and 5 pears then 5 plums and 5 grapes to the tall man at the gate"
    docs = documents([(0, item.replace("5", "7")), (1, "give 1 apples and 2 pears then 3 plums and 4 grapes to the tall man at the gate")])
    assert [r.doc_id for r in matches(docs, items(spark, [(1, item)])).collect()] == [0]


def test_items_of_one_template_are_judged_each_by_itself(spark, documents):
    item = "the old man at the gate sells 3 apples and {} pears to the tall woman"
    docs = documents([(k, item.format(k)) for k in (3, 5)])
    got = matches(docs, items(spark, [(1, item.format(3)), (2, item.format(5))])).collect()
    assert sorted((r.doc_id, r.item_id, r.changed, r.n_items) for r in got) == [(3, 1, 0, 2), (5, 1, 0, 2)]


def test_all_positions_and_the_shuffled_way(spark, documents):
    rng = random.Random(6)
    wanted = text(rng, 15)
    docs = documents([(k, " ".join([*text(rng, k + 1).split(), wanted, *text(rng, 9).split()])) for k in range(9)])
    near = matches(docs, items(spark, [(1, wanted)])).select("doc_id", "item_id")
    far = matches(docs, items(spark, [(1, wanted)]), broadcast_bytes=0).select("doc_id", "item_id")
    assert sorted(near.collect()) == sorted(far.collect()) == [(k, 1) for k in range(9)]


def test_items_of_all_lengths_at_all_positions(spark, documents):
    rng = random.Random(8)
    wanted = {n: " ".join(words(rng, n)) for n in range(3, 21)}
    rows = [(100 * n + k, " ".join([*words(rng, k), wanted[n], *words(rng, 9)])) for n in wanted for k in (0, 1, 2, 3, 4, 5, 6, 7, 40)]
    for far in ({}, {"broadcast_bytes": 0}):
        got = matches(documents(rows), items(spark, list(wanted.items())), **far).select("doc_id", "item_id")
        assert sorted(map(tuple, got.collect())) == [(k, k // 100) for k, _ in rows]


def test_very_short_items_match_whole_texts_only(spark, documents):
    docs = documents([(1, "one two"), (2, "say one two now"), (3, "One, two."), (4, "three"), (5, "three four five")])
    got = matches(docs, items(spark, [(1, "one two"), (2, "three"), (3, "")])).select("doc_id", "item_id")
    assert sorted(map(tuple, got.collect())) == [(1, 1), (3, 1), (4, 2)]


def test_items_of_mostly_placeholders_are_found_verbatim(spark, documents):
    rng = random.Random(9)
    odd = ["12 + 7 = 19, 3 + 4 = 7, 20 + 22 = 42, 8 + 9 = 17", "What Is The Highest Mountain In The World And How High Is It In Meters"]
    docs = documents([(10 * k + n, " ".join([*words(rng, n), t, *words(rng, 5)])) for k, t in enumerate(odd) for n in range(4)] + [(99, "What is high? 12 + 8 = 20, 4 + 4 = 8")])
    got = matches(docs, items(spark, list(enumerate(odd)))).select("doc_id", "item_id")
    assert sorted(map(tuple, got.collect())) == [(10 * k + n, k) for k in (0, 1) for n in range(4)]


def test_slots_of_other_lengths(spark, documents):
    """Names of more words, and 15km for 15 km, shift what follows by nothing; a dropped word shifts the rest by one."""
    item = "a train leaves the old station at 15 km per hour and passes Paris after a while with many people aboard it"
    other = "a train leaves the old station at 47km per hour and passes New York City after a while with many people aboard it"
    shorter = "a train leaves the old station at 15 km per hour and after a while with many people aboard it"
    docs = documents([(1, other), (2, "so " + shorter), (3, "a train leaves the old station at noon"), (4, "b " * 50_000 + other)])
    got = {r.doc_id: r for r in matches(docs, items(spark, [(1, item)])).collect()}
    assert set(got) == {1, 2, 4} and got[1].coverage == got[4].coverage == 1.0 and got[1].changed == 2
    assert got[2].coverage > 0.9


@pytest.mark.parametrize("apart", [0, 10, 24, 30, 60, 100])
def test_items_in_two_parts(spark, documents, apart):
    rng = random.Random(21)
    wanted = words(rng, 20)
    docs = documents([(1, " ".join([*words(rng, 9), *wanted[:10], *words(rng, apart), *wanted[10:], *words(rng, 5)])), (2, " ".join(wanted[:10] + words(rng, 30)))])
    got = matches(docs, items(spark, [(1, " ".join(wanted))])).collect()
    assert [(r.doc_id, r.coverage) for r in got] == [(1, 1.0)]


def test_a_long_run_of_a_long_item_counts(spark, documents):
    rng = random.Random(22)
    wanted = words(rng, 100)
    docs = documents([(n, " ".join([*words(rng, 7), *wanted[30 : 30 + n], *words(rng, 7)])) for n in (10, 23, 24, 40, 59)])
    got = matches(docs, items(spark, [(1, " ".join(wanted))])).collect()
    assert sorted(r.doc_id for r in got) == [24, 40, 59] and all(r.doc_id <= 100 * r.coverage < r.doc_id + 5 for r in got)


def test_many_variants_of_one_template(spark, documents):
    """Items that differ by their figures only are judged once for each pattern of equal figures."""
    line = "the old man at the gate sells {} apples and {} pears to the tall woman for {} coins"
    bench = [(k, line.format(k, k + 1, 5000 + k)) for k in range(600)] + [(900, line.format(7, 7, 7))]
    entries = D.item_entries(items(spark, bench), "text", "item_id", 8).collect()
    assert [(r.n_items, len(r.patterns)) for r in entries if r.kind == D.TEMPLATE] == [(601, 2)]
    docs = documents([(1, line.format(3, 4, 5003)), (2, line.format(3, 9000, 5003)), (3, line.format(1, 1, 2)), (4, line.format(8000, 8000, 8000)), (5, line.format(3, 400, 5500))])
    got = matches(docs, items(spark, bench)).collect()
    assert sorted((r.doc_id, r.item_id, r.n_slots, r.changed) for r in got) == [(1, 0, 3, 0), (2, 0, 3, 1), (4, 0, 3, 3), (5, 0, 3, 0)]


def in_python(docs, benchmark, window=8, coverage=0.6):
    """The query by its definition, without hashes and joins."""
    def raw(t):
        t = regex.sub(D.NAME, D.MARK, t or "")
        t = regex.sub(r"\s+", " ", regex.sub(D.EDGES.replace("(?<=^|[\\s\\x01])", "(?:(?<=^)|(?<=[\\s\\x01]))"), "", t)).strip(" ")
        t = regex.sub(D.AMOUNT.replace("(?i)", "", 1), lambda m: m[1] + D.JOINT, t, flags=regex.I)
        return regex.sub(D.NAMES, lambda m: m[1] + D.JOINT, t)

    def template(r):
        t = regex.sub(r"\x01\S+", "<name>", r).lower()
        return regex.sub(D.NUMBER, "<num>", regex.sub(D.MEASURE, "<measure>", t))

    plain = lambda r: r.lower().replace(D.JOINT, " ").replace(D.MARK, "")
    split = lambda t: t.split(" ") if t else []
    entries = {}
    for k, t in benchmark:
        if r := raw(t):
            own = entries.setdefault(template(r), [k, 0, set()])
            own[0], own[1] = min(own[0], k), own[1] + 1
            own[2].add(r)
    looked = []
    for t, (k, n, raws) in entries.items():
        it = split(t)
        at = [a for a in range(len(it) - window + 1) if 2 * sum(x not in D.SLOTS for x in it[a : a + window]) >= window]
        looked.append((k, n, it, [split(r) for r in raws], at, window, False))
        if len(it) < window or len(at) < len(it) - window + 1:
            for p in {plain(r) for r in raws}:
                w = min(window, len(split(p)))
                looked.append((k, n, split(p), [split(p)], range(len(split(p)) - w + 1), w, True))
    out = {}
    for d, t in docs:
        r = raw(t)
        for k, n, it, raws, at, w, verbatim in looked:
            dr = split(plain(r)) if verbatim else split(r)
            dt = dr if verbatim else split(template(r))
            if len(it) < 3 and len(it) != len(dt):
                continue
            shifts = {}
            for b in range(len(dt) - w + 1):
                for a in at:
                    if dt[b : b + w] == it[a : a + w]:
                        shifts.setdefault(b - a, set()).add(a)
            parts = {}
            for s, hits in shifts.items():
                same = {p: dr[p + s] for p in range(len(it)) if 0 <= p + s < len(dt) and dt[p + s] == it[p]}
                runs = set()
                for a in hits:
                    while a in same:
                        runs.add(a)
                        a += 1
                longest = max((max(b for b in range(a, len(it) + 1) if all(p in same for p in range(a, b))) - a for a in hits), default=0)
                parts[s] = same, runs, longest
            for grid in (0, 1):
                for cell in {(s + grid * D.NEAR // 2) // D.NEAR for s in parts}:
                    near = sorted((s for s in parts if (s + grid * D.NEAR // 2) // D.NEAR == cell), key=lambda s: (-len(parts[s][0]), s))
                    merged = dict(parts[near[0]][0])
                    for s in near[1:]:
                        merged |= {p: v for p, v in parts[s][0].items() if p in parts[s][1] and p not in merged}
                    if len(merged) < coverage * len(it) - 1e-9 and max(parts[s][2] for s in near) < D.RUN * window:
                        continue
                    for own in raws:
                        pairs = {(own[p], v) for p, v in merged.items() if it[p] in D.SLOTS}
                        if len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}):
                            changed = sum(all(x[p] != v for x in raws) for p, v in merged.items() if it[p] in D.SLOTS)
                            best = (len(merged) / len(it), -changed, sum(it[p] in D.SLOTS for p in merged))
                            have = out.get((d, k), (0, (0, 0, 0)))
                            out[d, k] = max(n, have[0]), max(best, have[1])
    return sorted((d, k, n, c, s, -less) for (d, k), (n, (c, less, s)) in out.items())


def test_the_query_against_its_definition(spark, documents):
    rng = random.Random(31)
    fill = lambda: rng.choice(["7", "15 km", "15km", "3,5", "Paris", "New York", "Berlin", "90 %"])
    bench, rows = [], []
    for k in range(40):
        w = words(rng, rng.randint(1, 30))
        w = [fill() if rng.random() < (0.6 if k % 5 == 0 else 0.15) else x for x in w]
        bench.append((k, " ".join(w)))
    bench += [(50, bench[3][1]), (51, bench[4][1].replace("7", "8").replace("Paris", "Rome")), (52, None)]
    for k in range(160):
        parts = words(rng, rng.randint(0, 12))
        for _ in range(rng.randint(0, 2)):
            own = rng.choice(bench)[1] or ""
            own = own.split(" ")
            lo = rng.choice([0, 0, rng.randrange(len(own))])
            own = own[lo : rng.choice([len(own), rng.randint(lo, len(own))])]
            own = [fill() if x in ("7", "Paris", "Berlin") and rng.random() < 0.5 else x for x in own if rng.random() > 0.03]
            parts += own + words(rng, rng.randint(0, 9))
        rows.append((k, " ".join(parts) + rng.choice(["", ".", " (so)"])))
    rows += [(900, None), (901, ""), (902, " , . ")]
    want = in_python(rows, bench)
    for far in ({}, {"broadcast_bytes": 0}):
        got = sorted((r.doc_id, r.item_id, r.n_items, r.coverage, r.n_slots, r.changed) for r in matches(documents(rows), items(spark, bench), **far).collect())
        assert [g[:3] for g in got] == [w[:3] for w in want] and len(want) > 45
        assert all(abs(g[3] - w[3]) < 1e-9 and g[4:] == w[4:] for g, w in zip(got, want, strict=True))


def test_columns_of_any_name_and_plan(spark, documents):
    docs = documents([(1, ITEM), (2, "x"), (2, "x"), (None, None)], _id=1, _fa=2, raw="r", template="t", shift=4, tid=5, w=6, c0=7)
    kept = decontaminate(docs, items(spark, [(7, ITEM)]))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [2, 2, None] and kept.columns == docs.columns
    plan = kept._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_empty_tables(spark, documents, rows):
    assert matches(documents(rows), items(spark, [(1, ITEM)])).count() == 0
    assert matches(documents([(1, ITEM)]), items(spark, [])).count() == 0
    assert decontaminate(documents(rows), items(spark, [])).count() == len(rows)
