import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of (doc_id, text), with the other columns of the table."""

    def make(rows):
        return spark.createDataFrame(
            [(i, t, "en", "src0", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"
        )

    return make
