import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, n string, z string, text_hash string, extra string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from texts (or (text, lang)), with extra columns whose names the operators use inside."""

    def make(texts, ids=None):
        rows = []
        for i, t in enumerate(texts):
            text, lang = t if isinstance(t, tuple) else (t, "en")
            rows.append((ids[i] if ids else i, text, lang, None, None if text is None else len(text), "s", "n", "z", "h", None))
        return spark.createDataFrame(rows, SCHEMA)

    return make
