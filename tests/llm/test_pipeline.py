import random
import re
from collections import Counter

import corpus_pipeline
from lodestrata.llm import pii
from tests_llm_fixtures import changed, text

ITEM = "a train leaves the old station at 15 km per hour and passes Paris after 3 hours with 120 people aboard it"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, folder):
    rng = random.Random(8)
    rows = [(k, text(rng, rng.randint(20, 90), ("en", "fr", "de")[k % 3]), ("en", "fr", "de")[k % 3]) for k in range(90)]
    near = text(rng, 150)
    rows += [(200, near, "en"), (201, changed(rng, near, 1), "en"), (202, near, "en"), (203, "123 456", "en"), (204, None, "en"), (205, text(rng, 30) + " " + ITEM + " " + text(rng, 30), "en"), (206, text(rng, 30) + " mail a.b@c.org now", "en"), (207, "", "en"), (208, rows[4][1], "fr"), (208, rows[4][1], "fr")]
    full = [(k, t, lang, "s", len(t or "")) for k, t, lang in rows]
    spark.createDataFrame(full, COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows


def test_stages_keep_clean_documents_and_columns(spark, tmp_path):
    rows = make(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
        if name != "packed":
            assert docs.columns == columns
    ids = lambda name: Counter(r.doc_id for r in seen[name])
    everything = Counter(k for k, _, _ in rows)
    assert ids("language") == everything - Counter([203, 204, 207])
    assert ids("near_duplicates") == ids("language") - Counter([201, 202, 208, 208])
    assert ids("benchmark") == ids("near_duplicates") - Counter([205])
    texts = {r.doc_id: r for r in seen["personal_data"]}
    assert ids("personal_data") == ids("benchmark")
    assert "<email>" in texts[206].text and texts[206].n_chars == len(texts[206].text)
    assert not any(pii.base_spans(r.text) for r in seen["personal_data"])
    assert {r.doc_id for r in seen["packed"]} == set(texts)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["packed"])
    assert re.match("packed", corpus_pipeline.STAGES[-1][0])


ODD = {"_id": 1, "_row": 2, "_lang_pred": "x", "lang_pred": "y", "score": 0.5, "text_": "t", "c0": 3, "row": 4, "fa": 5, "kept": "k", "Shard": 6}


def odd_documents(spark, rows):
    kinds = {int: "long", str: "string", float: "double"}
    schema = COLUMNS + ", " + ", ".join(f"`{k}` {kinds[type(v)]}" for k, v in ODD.items())
    return spark.createDataFrame([(k, t, lang, "s", len(t or ""), *ODD.values()) for k, t, lang in rows], schema)


def test_stages_with_odd_tables(spark, tmp_path):
    """Columns that clash with inner names, nulls, ties, repeats and a very long text."""
    rng = random.Random(9)
    rows = [(k, text(rng, rng.randint(20, 60), lang), lang) for k, lang in enumerate(["en", "fr", "de"] * 20)]
    long = text(rng, 40_000)
    rows += [(100, long, "en"), (101, changed(rng, long, 40), "en"), (None, rows[1][1], None), (None, None, None), (7, rows[7][1], "fr"), (7, rows[7][1], "fr"), (102, "x" * 100_000, "en"), (103, "語" * 3000, None)]
    make(spark, str(tmp_path))
    docs = odd_documents(spark, rows)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name == "packed":
            break
        assert out.columns == columns
        out.write.parquet(f"{tmp_path}/odd-{name}")
        docs = spark.read.parquet(f"{tmp_path}/odd-{name}")
        assert all(tuple(r[c] for c in ODD) == tuple(ODD.values()) for r in docs.collect())
        ids = Counter(r.doc_id for r in docs.collect())
        assert ids[100] == 1 and ids[7] == (3 if name == "language" else 1)
        assert ids[101] == (name == "language") and ids[103] == 0
        assert ids[None] == (name == "language")
    assert sum(r.length for r in out.filter("doc_id = 100").collect()) > 40_000


def test_stages_with_an_empty_table(spark, tmp_path):
    make(spark, str(tmp_path))
    for _, stage in corpus_pipeline.STAGES:
        docs = odd_documents(spark, [])
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0 and (out.columns == docs.columns or stage is corpus_pipeline.packed)
