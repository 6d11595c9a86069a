"""The order- and reference-dependent operators against their definitions, on generated cases."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import matching
from lodestrata.operators import chains, claims, headers, islands, overlap, presence, reservation, running, tolerant


def test_dated_headers_take_their_lines(spark):
    docs = [
        (1, "Acme Works\nEngineer\n2019-2021\nBuilt things.\nOther Shop 2017-2018"),  # three lines, then one
        (2, "A\nB\nC\n2019-2021"),  # only the two lines before the date belong to it
        (3, "- bullet\n2019-2021\nPlain words from 2019 to 2020 in a sentence."),
        (4, "Skills\n2019-2021"),  # a section's heading is part of no header
        (5, "Shop\n2015-2016\n2017-2018"),  # the first date is taken, the second stands alone
        (6, None),
        (7, ""),
    ]
    got = headers.header_groups(spark.createDataFrame(docs, "doc_id int, text string"), "doc_id")
    assert sorted(map(tuple, got.collect())) == [(1, 1, 2), (1, 5, 0), (2, 2, 2), (3, 2, 0), (4, 2, 0), (5, 1, 1), (5, 3, 0)]


@pytest.mark.parametrize("seed", range(3))
def test_headers_never_overlap(spark, seed):
    rng = random.Random(seed)
    docs = [(k, "\n".join(rng.choice("aoc") for _ in range(rng.randint(1, 30)))) for k in range(60)]
    flags = lambda x: F.struct((x == "a").alias("alone"), (x == "o").alias("opens"), (x == "c").alias("closes"))
    want = []
    for doc, t in docs:
        lines, at = t.split("\n"), 0
        while at < len(lines):
            rest = "".join(lines[at : at + 3])
            reach = 0 if rest[0] == "a" else 1 if rest[:2] == "oc" else 2 if rest == "ooc" else None
            if reach is not None:
                want.append((doc, at + 1, reach))
            at += 1 + (reach or 0)
    got = headers.header_groups(spark.createDataFrame(docs, "doc_id int, text string"), "doc_id", flags=flags)
    assert sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("seed", range(3))
def test_places_are_exclusive(spark, seed):
    rng = random.Random(seed)
    rows = [(d, w, (a := rng.randrange(40)), a + 1 + w % 5) for d in range(40) for w in rng.sample(range(12), rng.randint(1, 8)) for _ in range(rng.randint(1, 4))]
    want = []
    for d in {r[0] for r in rows}:
        taken = {}
        for _, w, a, b in sorted({r for r in rows if r[0] == d}, key=lambda r: (r[2] - r[3], r[1], r[2])):
            if w not in taken and all(b <= x or a >= y for x, y in taken.values()):
                taken[w] = a, b
        want += [(d, w, *taken.get(w, (None, None))) for w in {r[1] for r in rows if r[0] == d}]
    got = reservation.exclusive_places(spark.createDataFrame(rows, "d int, w int, low int, high int"), "d", ["w"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_exclusive_coverage_agrees_with_the_matcher(spark):
    rng = random.Random(9)
    parts = ["led team", "team", "led", "3", "3,000", "well-known", "a team of 3"]
    docs = [(k, " ".join(rng.choice([*parts, "and", "\n"]) for _ in range(rng.randint(1, 9)))) for k in range(80)]
    items = list(enumerate(parts))
    got = tolerant.tolerant_coverage(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string"), "doc_id", "text", "item_id", "text")
    placed = defaultdict(set)
    for r in got.collect():
        if r.low is not None:
            placed[r.doc_id].add(r.item_id)
    for doc, t in docs:
        missing = set(matching.missing(parts, t))
        assert placed[doc] == set(range(len(parts))) - missing, t


def wrapped(rng, t):
    """A text as a page may show it: spaces become line breaks, words are hyphenated."""
    out = re.sub(" ", lambda m: rng.choice([" ", " ", "\n", "  \n "]), t)
    return re.sub(r"(?<=[a-z]{2})(?=[a-z]{2})", lambda m: "-\n" if rng.random() < 0.1 else "", out)


@pytest.mark.parametrize("small", [1 << 20, 0])
def test_wrapped_items_are_found_and_changed_ones_are_not(spark, small):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    number = lambda: rng.choice(["", "-", "+", "."]) + str(rng.randint(1, 9999)) + rng.choice(["", ",5", ".25", "%"])
    items = [(k, " ".join(rng.choice([word, word, number])() for _ in range(rng.randint(2, 9)))) for k in range(25)]
    docs, want = [], set()
    for k in range(120):
        item, t = rng.choice(items)
        changed = rng.random() < 0.4
        shown = re.sub(r"[a-h0-9](?!.*[a-h0-9])", "z", t, flags=re.S) if changed else wrapped(rng, t)
        docs.append((k, f"{word()}x {shown} x{word()}"))
        if not changed:
            want.add((k, item))
    docs += [(900, None), (901, ""), (902, " - \n-")]
    got = tolerant.tolerant_presence(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame([*items, (70, None), (71, " - ")], "item_id int, text string"), "doc_id", "text", "item_id", "text", small=small)
    found = set(map(tuple, got.collect()))
    assert found == {(d, i) for d, t in docs if t for i, w in items if matching.is_present(w, t)} and want <= found


def test_token_places_in_both_ways(spark):
    rng = random.Random(5)
    docs = [(k, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 14)))) for k in range(60)] + [(90, None)]
    items = [(k, " ".join(rng.choice("ab") for _ in range(rng.randint(1, 8)))) for k in range(20)] + [(90, "")]
    args = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string"), "doc_id", "text", "item_id", "text"
    want = sorted((d, i, a, len(w.split())) for d, t in docs if t for i, w in items if w for a in range(len(t.split())) if t.split()[a : a + len(w.split())] == w.split())
    for small in (1 << 20, 0):
        assert sorted(map(tuple, presence.token_places(*args, small_bytes=small).collect())) == want


@pytest.mark.parametrize("blocks", [1, 3, 256])
def test_sums_before(spark, blocks):
    rng = random.Random(blocks)
    rows = [(rng.choice([None, "a", "b", "b", "b"]), k, rng.randint(0, 5), 1) for k in range(300)]
    got = running.sums_before(spark.createDataFrame(rows, "s string, o int, v int, w int"), ["s"], "o", {"v": "before", "w": "more"}, blocks).collect()
    assert len(got) == 300 and all(r.before == sum(v for s, o, v, _ in rows if s == r.s and o < r.o) and r.more == sum(s == r.s and o < r.o for s, o, _, _ in rows) for r in got)


def test_assembled_claims_and_sections(spark):
    docs = [("x", 1, "one\ntwo\n\nthree"), ("x", 3, "\n\n one\n"), ("x", 2, None), ("y", 4, "one"), (None, 5, "a\n \nb"), ("x", 6, "one\n\none")]
    df = spark.createDataFrame(docs, "source string, doc_id int, text string")
    got = claims.assembled_claims(df, "source", "doc_id").orderBy("source", "claim_id").collect()
    assert [(r.source, r.doc_id, r.line, r.claim_id[-1], r.path, r.text) for r in got] == [
        (None, 5, 1, "1", "sections[0].entries[0]", "a"), (None, 5, 3, "2", "sections[1].entries[0]", "b"),
        ("x", 1, 1, "1", "sections[0].entries[0]", "one"), ("x", 1, 2, "2", "sections[0].entries[1]", "two"), ("x", 1, 4, "3", "sections[1].entries[0]", "three"),
        ("x", 3, 3, "4", "sections[2].entries[0]", "one"), ("x", 6, 1, "5", "sections[3].entries[0]", "one"), ("x", 6, 3, "6", "sections[4].entries[0]", "one"),
        ("y", 4, 1, "1", "sections[0].entries[0]", "one"),
    ]
    named = claims.assembled_sections(df, "source", "doc_id", F.col("title")).filter("source = 'x'").orderBy("section").collect()
    assert [(r.section, r.n_lines, r.section_id) for r in named] == [(0, 2, "one"), (1, 1, "three"), (2, 1, "one-2"), (3, 1, "one-3"), (4, 1, "one-4")]


@pytest.mark.parametrize("seed", range(4))
def test_chains(spark, seed):
    rng = random.Random(seed)
    n = rng.choice([1, 7, 40])
    to = {k: rng.choice([None, *range(n), n + 5]) if rng.random() < 0.3 + 0.2 * seed else rng.choice([None, k + 1 if k + 1 < n else None]) for k in range(n)}
    follow = {k: v if v in to else None for k, v in to.items()}
    want = []
    for k in to:
        path, at = [k], k
        while follow[at] is not None and follow[at] not in path:
            at = follow[at]
            path.append(at)
        if follow[at] is None:
            want.append((k, at, len(path) - 1, False, False))
        else:
            circle = path[path.index(follow[at]) :]
            want.append((k, min(circle), None, True, k in circle))
    got = chains.chains(spark.createDataFrame(list(to.items()), "node int, to int"), "node", "to").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_corrections_point_both_ways(spark):
    newer = spark.createDataFrame([(2, 1), (3, 2), (4, 9), (5, None)], "id int, old int")
    older = spark.createDataFrame([(1, 2), (2, None), (3, 5), (4, None), (5, None)], "id int, superseded_by int")
    assert sorted(map(tuple, chains.unreciprocated(newer, older).collect())) == [(3, 2, "not_acknowledged"), (4, 9, "unknown"), (5, 3, "not_claimed")]


@pytest.mark.parametrize("least", [1, 2, 3])
def test_sets_that_overlap(spark, least, monkeypatch):
    monkeypatch.setattr(overlap, "BLOCK", 7)
    rng = random.Random(least)
    sets = {k: {0, *(rng.randrange(1, 25) for _ in range(rng.randint(0, 5)))} if k % 3 else {rng.randrange(25) for _ in range(3)} for k in range(50)}
    rows = [(k, e) for k, own in sets.items() for e in own] * 2 + [(None, 1), (99, None)]
    got = overlap.overlapping_sets(spark.createDataFrame(rows, "id int, e int"), "id", "e", least).collect()
    want = [(a, b, len(sets[a] & sets[b]), sorted(sets[a] & sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= least]
    assert sorted(map(tuple, got)) == sorted((a, b, n, e) for a, b, n, e in want)


def test_a_key_first_and_equal_values_else(spark):
    fields = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (1, "c", None), (2, "a", "y")], "s int, path string, value string")
    rows = spark.createDataFrame([(1, 1, "a", "q"), (2, 1, "z", "x"), (3, 1, "z", "q"), (4, 1, "z", None), (5, 2, "b", "x"), (6, 2, "a", "y")], "id int, s int, path string, value string")
    got = overlap.first_or_equal(rows, fields, ["s"], "path", "value").collect()
    assert sorted(((r.id, r.field, r.tier) for r in got), key=str) == [(1, "a", "key"), (2, "a", "value"), (2, "b", "value"), (3, None, None), (4, None, None), (5, None, None), (6, "a", "key")]


def test_continued_lines(spark):
    docs = [(1, "One\ntwo.\nthree-\nfour\n- five\nsix\n\nseven"), (2, ""), (3, None), (4, "\n a \n")]
    got = islands.continued_lines(spark.createDataFrame(docs, "doc_id int, text string"), "doc_id").orderBy("doc_id", "line_start").collect()
    assert [tuple(r) for r in got] == [(1, 1, 2, 2, "One two."), (1, 3, 4, 2, "three-four"), (1, 5, 6, 2, "- five six"), (1, 8, 8, 1, "seven"), (4, 2, 2, 1, "a")]


def test_islands_hang_on_their_anchor(spark):
    rng = random.Random(6)
    rows = [(s, o, rng.randint(0, 4)) for s in range(20) for o in range(12)]
    want = []
    for s in range(20):
        anchor, island = None, 0
        for _, o, d in (r for r in rows if r[0] == s):
            if anchor is None or d <= rows[s * 12 + anchor][2]:  # not deeper than the line that the island hangs on
                anchor, island = o, island + 1
            want.append((s, o, d, island, anchor))
    got = islands.anchored_islands(spark.createDataFrame(rows, "s int, o int, d int"), ["s"], "o", "d").collect()
    assert sorted(map(tuple, got)) == want


def test_merged_cells(spark):
    rows = [
        (1, 0, 0, 1, "restart"), (1, 0, 1, 2, "restart"), (1, 0, 3, 1, None),
        (1, 1, 0, 1, "continue"), (1, 1, 1, 2, "continue"), (1, 1, 3, 1, "continue"),  # nothing to continue in column 3
        (1, 2, 0, 1, "restart"), (1, 2, 1, 2, "continue"), (1, 2, 3, 1, "continue"),
        (1, 4, 0, 1, "continue"), (1, 4, 1, 1, None),  # row 3 is missing
        (2, 0, 0, 1, "continue"),
    ]
    got = islands.row_spans(spark.createDataFrame(rows, "table int, row int, column int, width int, state string")).collect()
    none = (None, None, None)
    assert {(r.table, r.row, r.column): (r.origin_row, r.origin_column, r.row_span) for r in got} == {
        (1, 0, 0): (0, 0, 2), (1, 0, 1): (0, 1, 3), (1, 0, 3): (0, 3, 1), (1, 1, 0): (0, 0, 2), (1, 1, 1): (0, 1, 3), (1, 1, 3): none,
        (1, 2, 0): (2, 0, 1), (1, 2, 1): (0, 1, 3), (1, 2, 3): none, (1, 4, 0): none, (1, 4, 1): (4, 1, 1), (2, 0, 0): none,
    }


def test_the_ledger_sees_dropped_and_doubled_claims(spark):
    from lodestrata.operators import coverage

    docs = spark.createDataFrame([("a", 1, "one\r\n\n- two three"), ("a", 2, None), ("b", 3, " \t\nx"), ("c", 4, "y\nz")], "source string, doc_id int, text string")
    made = claims.assembled_claims(docs, "source", "doc_id").select("doc_id", "line", "text")
    row = lambda c: sorted(map(tuple, coverage.ledger(docs, c, "source", "doc_id", "text").collect()))
    assert row(made) == [("a", 2, 3, 3, 2, True), ("b", 1, 1, 1, 1, True), ("c", 1, 2, 2, 2, True)]
    assert [r[-1] for r in row(made.filter("text <> 'z'"))] == [True, True, False]
    assert [r[-1] for r in row(made.unionByName(made.filter("text = 'x'")))] == [True, False, True]
    moved = made.withColumn("line", F.when(F.col("text") == "x", 1).otherwise(F.col("line")))
    assert [r[-1] for r in row(moved)] == [True, False, True]


def test_page_coverage_counts_lines_on_its_own(spark):
    from lodestrata.operators import coverage

    blocks = spark.createDataFrame([(1, 1, "Skills\nPython"), (1, 2, "- a\n\n2019 - 2021"), (2, 1, "x@y.org")], "page_id int, seq int, text string")
    got = {r.page_id: r for r in coverage.page_coverage(blocks, "page_id").collect()}
    assert (got[1].blocks, got[1].segments, got[1].section_candidate, got[1].date_candidate, got[1].original_bullet, got[1].unclassified, got[1].complete) == (2, 4, 1, 1, 1, 1, True)
    assert got[2].contact_candidate == 1 and got[2].complete


@pytest.mark.parametrize("seed", range(20))
def test_numbers_stand_for_themselves_only(seed):
    """A figure is there if it stands between blanks or marks that can't belong to a number; signs, digits, letters and separators beside it make it another."""
    rng = random.Random(seed)
    n = str(rng.randint(1, 99_999)) if rng.random() < 0.6 else f"{rng.randint(0, 99)}.{rng.randint(0, 99)}"
    digit, letter = str(rng.randrange(10)), rng.choice("abXYé_")
    same = [n, f"({n})", f"{n}.", f"{n},", f"{n}%", f"x {n}\ny", f"/{n}/", f"{n}:", f"数{n}"]
    other = [f"-{n}", f"+{n}", f".{n}", f"{digit}{n}", f"{n}{digit}", f"{n}{letter}", f"{letter}{n}", f"{digit},{n}", f"{n}.{digit}", f"{n},{digit}", f"−{n}", f"–{n}"]
    for shown in same:
        assert matching.is_present(n, f"a {shown} b"), shown
    for shown in other:
        assert not matching.is_present(n, f"a {shown} b"), shown
    assert matching.missing([n, n], f"{rng.choice(same)} and {rng.choice(other)}") == [1]
