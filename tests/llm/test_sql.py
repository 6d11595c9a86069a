"""The registered queries against their SQL on the driver's small tables."""

import os

import duckdb
import pytest

from lodestrata.llm import queries

ROOT = "/root/testdata"


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name, sf):
    if not os.path.isdir(f"{ROOT}/{sf}"):
        pytest.skip("needs the test tables")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, f"{ROOT}/{sf}")
    want = con.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    rows = want.select(*[f'"{c}"' for c in df.columns]).fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(rows)
