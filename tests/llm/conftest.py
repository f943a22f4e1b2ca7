import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars int"


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents of (id, text) pairs, with the table's columns."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)

    return make
