import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text) pairs, with further columns whose names clash with those that operators make."""

    def make(rows):
        extra = "lang string, source string, n_chars long, score double, spans string, kept_text string, n_words string, component_id string"
        full = [(i, t, "en", "s", len(t) if t is not None else None, 1.0, "x", "y", "z", "w") for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, " + extra)

    return make
