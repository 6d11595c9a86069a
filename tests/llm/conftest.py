
import pytest

pytest.importorskip("lodestrata.llm")


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (doc_id, text) as a table of documents with extra columns whose names clash with the operators' own."""

    def make(rows, **extra):
        names = {"id": 1, "row": 2, "h": 3, "size": 4, "member": "m", "n": 5, "score": 0.5, "lang_pred": "zz"} | extra
        schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{k}` {'string' if isinstance(v, str) else 'double' if isinstance(v, float) else 'long'}" for k, v in names.items())
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or ""), *names.values()) for r in rows]
        return spark.createDataFrame(full, schema)

    return make
