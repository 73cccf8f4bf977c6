import pytest


@pytest.fixture
def docs(spark):
    """A documents table of (doc_id, text) with columns of names that operators use themselves."""

    def make(rows):
        rows = [(k, t, "en", "s", 0, 1, "x", 2) for k, t in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node long, spans string, rank int")

    return make


@pytest.fixture
def columns():
    return ["doc_id", "text", "lang", "source", "n_chars"]
