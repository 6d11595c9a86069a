import random

import duckdb
import pytest

from lodestrata.llm import chat_formatting as C
from lodestrata.llm.scratch import Scratch

SCHEMA = "conv_id long, turn long, role string, text string, n long, pos string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def brute(rows):
    convs = {}
    for c, t, r, x in {(c, t, r or "", x or "") for c, t, r, x in rows}:
        convs.setdefault(c, []).append((t is not None, t or 0, r, x))
    said = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}
    out = []
    for c, own in said.items():
        same = [k for k, v in said.items() if v == own]
        if c != min((k for k in same), key=lambda k: (k is None, k or 0)) or any(len(v) > len(own) and v[: len(own)] == own for v in said.values()):
            continue
        out.append((c, len(own), len(same), "".join(f"<|{r}|>\n{x}\n" for r, x in own)))
    return sorted(out, key=str)


def snapshots(seed):
    rng = random.Random(seed)
    rows = []
    for c in range(30):
        if c % 3 and c > 3:
            take = rng.randrange(c)
            own = [r[1:] for r in rows if r[0] == take]
            own = own[: rng.randint(1, len(own))] + ([(len(own), "user", f"more {c}")] if c % 2 else [])
        else:
            own = [(k, ("user", "assistant")[k % 2], f"{rng.randint(0, 2)}") for k in range(rng.randint(1, 6))]
        rows += [(c, *r) for r in own]
    return rows


@pytest.mark.parametrize("rows", [snapshots(1), snapshots(2), [], [(1, 0, None, None)], [(1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, "user", "a"), (None, 0, "user", "b")], [(1, None, "user", "z"), (1, 0, "user", "a")], [(1, 5, "user", "a"), (1, 9, "user", "b"), (2, 0, "user", "a")], [(1, k, "user", str(k)) for k in range(600)] + [(2, k, "user", str(k)) for k in range(300)]])
def test_against_brute_force_and_sql(spark, rows):
    got = C.collapse_conversations(table(spark, rows))
    assert got.columns == ["conv_id", "n_turns", "n_copies", "chat"]
    got = sorted((tuple(r) for r in got.collect()), key=str)
    assert got == brute(rows)
    if rows and all(r[0] is not None for r in rows):
        con = duckdb.connect()
        con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
        con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
        assert sorted(con.sql(C.ORACLE_SQL).fetchall(), key=str) == got


def test_plan_is_native(spark):
    plan = C.collapse_conversations(table(spark, snapshots(1)))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_scratch_tables_are_dropped(spark):
    scratch = Scratch(spark, "t")
    t = scratch.save(spark.range(5))
    assert t.count() == 5
    scratch.drop(t)
    with pytest.raises(Exception):
        spark.read.parquet(t._scratch_path)
