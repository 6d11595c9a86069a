"""Every registered query of the engine against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from lodestrata.plans import suite

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(suite.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    df = suite.queries()[name](spark, SF)
    want = con.sql(suite.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    at = [want.columns.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[k]) for k in at) for r in want.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(suite.queries()) - set(suite.oracle_sql())))
def test_query_runs(spark, name):
    assert suite.queries()[name](spark, SF).count() > 0


def test_pages_are_fully_accounted_for(spark):
    assert suite.flagship(spark, SF).filter("not complete").count() == 0


def test_paragraphs(spark):
    from lodestrata.operators import segments as S

    docs = spark.createDataFrame([(1, "\n\na\nb\n \n\nc\n"), (2, ""), (3, "x"), (4, None)], "doc_id int, text string")
    got = [tuple(r) for r in S.paragraphs(docs).orderBy("doc_id", "paragraph").collect()]
    assert got == [(1, 1, 3, 4, "a\nb"), (1, 2, 7, 7, "c"), (3, 1, 1, 1, "x")]
    assert [tuple(r)[:3] for r in S.segments(docs).orderBy("doc_id", "line_in_block").collect()] == [(1, 3, "a"), (1, 4, "b"), (1, 7, "c"), (3, 1, "x")]
    headers = S.lookahead_headers(spark.createDataFrame([(1, "Acme\nLead\n2019-2021\nDid it.\nX 2018-2019")], "doc_id int, text string"), "doc_id")
    assert [tuple(r) for r in headers.orderBy("line").collect()] == [(1, 1, 2), (1, 2, 1), (1, 3, 0), (1, 5, 0)]


def test_global_ids_and_temporal_rules(spark):
    from lodestrata.operators import conflicts, integrity

    rows = spark.createDataFrame([("b", 1), ("a", 2), ("a", 1)], "s string, o int")
    assert sorted((r.s, r.o, r.claim_id) for r in integrity.global_ids(rows, "s", "o").collect()) == [("a", 1, "claim-000001"), ("a", 2, "claim-000002"), ("b", 1, "claim-000003")]
    facts = spark.createDataFrame([(1, 1, 3), (1, 2, None)], "c int, t int, gone int")
    cites = spark.createDataFrame([(1, 1, 1), (1, 1, 3), (1, 2, 1), (1, 9, 3)], "c int, cited int, at int")
    got = sorted((r.cited, r["at"], r.validity) for r in integrity.temporal_validity(cites, facts, "c", "cited", "at", "t", "gone").collect())
    assert got == [(1, 1, "valid"), (1, 3, "superseded"), (2, 1, "future"), (9, 3, "unknown")]
    entries = spark.createDataFrame([("Acme  Co", "2019-2021"), ("ACME CO", "2019 – 2021"), ("acme co", "2018-2021"), ("Solo", "2019-2021"), ("Solo", "2019 to 2021"), (None, "x")], "heading string, date string")
    assert [(r.heading, r["values"]) for r in conflicts.entry_date_conflicts(entries).collect()] == [("acme co", ["2018-2021", "2019 – 2021", "2019-2021"])]


def test_global_ids_over_blocks_and_null_scopes(spark):
    from lodestrata.operators import integrity

    rows = [(s, o) for s in [None, *"dbeca"] for o in (2, 1)]
    got = integrity.global_ids(spark.createDataFrame(rows, "s string, o int"), "s", "o", blocks=3).collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert sorted((r.claim_id, r.s, r.o) for r in got) == [(f"claim-{k:06d}", *r) for k, r in enumerate(want, 1)]


def test_presence_needs_whole_runs(spark):
    from lodestrata.operators import presence

    docs = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d e f x h"), (3, None), (4, ""), (5, "b  c\nd")], "doc_id int, text string")
    items = spark.createDataFrame([(1, "a b c d e f g"), (2, "b c d"), (3, ""), (4, None)], "item_id int, text string")
    got = presence.token_presence(docs, items, "doc_id", "text", "item_id", "text").collect()
    assert sorted(map(tuple, got)) == [(1, 1), (1, 2), (2, 2), (5, 2)]
    assert presence.token_presence(docs, items.limit(0), "doc_id", "text", "item_id", "text").count() == 0
