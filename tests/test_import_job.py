"""Whole imports, and pages."""

import json

import pytest

from lodestrata.operators import integrity, pages
from lodestrata.plans import import_job
from lodestrata.sources import reader

ONE = "Ada Lovelace\nada@example.com\nExperience\nAcme 2019-2021\n- Led 3 users with SQL\n"
TWO = {"language": "en", "name": "Ada Lovelace", "headline": "", "contacts": ["ada@example.com"], "facts_confirmed": True, "sections": [{"id": "experience", "title": "Experience", "entries": [{"heading": "ACME", "date": "2018-2021", "bullets": ["Wrote tests"]}]}]}


@pytest.fixture
def sources(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text(ONE)
    (tmp_path / "in/b.json").write_text(json.dumps(TWO))
    return [str(tmp_path / "in/a.txt"), str(tmp_path / "in/b.json")]


def test_import(spark, sources, tmp_path):
    out = str(tmp_path / "out")
    import_job.import_sources(spark, sources, out)
    ledger = spark.read.parquet(f"{out}/ledger").first()
    profile = json.loads(ledger.profile)
    assert profile["name"] == "Ada Lovelace" and profile["facts_confirmed"] is False
    assert [s["id"] for s in profile["sections"]] == ["experience", "experience-2"]
    assert [c["kind"] for c in json.loads(ledger.conflicts)] == ["entry_dates_disagree"]
    assert ledger.segments == ledger.accounted == spark.read.parquet(f"{out}/claims").count() > 0
    kinds = [r.kind for r in spark.read.parquet(f"{out}/improvements").orderBy("rank").collect()]
    assert kinds == ["source_review", "result_scope", "personal_action"]
    assert {r.role for r in spark.read.parquet(f"{out}/directions").collect()} == {"data", "product"}
    with pytest.raises(ValueError):
        import_job.import_sources(spark, sources, out)


def test_unusable_sources_publish_nothing(spark, sources, tmp_path):
    (tmp_path / "in/c.docx").write_bytes(b"broken")
    with pytest.raises(ValueError, match="error"):
        import_job.import_sources(spark, [*sources, str(tmp_path / "in/c.docx")], str(tmp_path / "out"))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["in"]
    for bad in ([], sources * 2):
        with pytest.raises(ValueError):
            import_job.import_sources(spark, bad, str(tmp_path / "out"))


def test_changed_sources_are_stale(spark, sources):
    before = spark.createDataFrame(import_job.digests(reader.read_files(spark, sources)).collect())
    with open(sources[0], "a") as f:
        f.write("more")
    after = import_job.digests(reader.read_files(spark, sources))
    assert [(r.path.rsplit("/", 1)[-1], r.state) for r in integrity.stale(before, after, "path", "sha256").collect()] == [("a.txt", "changed")]


def test_pages(spark):
    words = spark.createDataFrame([(1, 1, 1, 1, 1, 2, "world", 0.5), (1, 1, 1, 1, 1, 1, "hello", 0.9), (1, 1, 1, 1, 2, 1, "x", 0.8), (1, 1, 1, 1, 2, 2, " ", 0.1)], "doc_id int, page int, block int, par int, line int, word int, text string, confidence double")
    got = [(r.text, r.confidence, r.needs_review) for r in pages.recognised_lines(words).orderBy("line").collect()]
    assert got == [("hello world", 0.5, True), ("x", 0.8, False)]
    sizes = spark.createDataFrame([(1, 1, 595.3, 841.9), (1, 2, 595.3, 841.9), (2, 1, 595.3, 841.9), (2, 3, 612.0, 792.0)], "doc_id int, page int, width double, height double")
    assert [tuple(r) for r in pages.page_check(sizes).orderBy("doc_id").collect()] == [(1, 2, True, True), (2, 2, False, False)]
    fields = spark.createDataFrame([(1, 0, "name", "Ada"), (1, 1, "bullet", "Led team"), (2, 0, "name", "Ada")], "doc_id int, ord int, path string, value string")
    texts = spark.createDataFrame([(1, "Ada\nLed  team"), (2, "Adam")], "doc_id int, text string")
    assert [tuple(r) for r in pages.text_report(fields, texts).orderBy("doc_id").collect()] == [(1, "passed", []), (2, "failed", ["name"])]
