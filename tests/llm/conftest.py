import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """A small table of documents with edge cases; makes a DataFrame from a list of (id, text)."""

    def make(rows, schema="doc_id long, text string"):
        return spark.createDataFrame(rows, schema)

    return make
