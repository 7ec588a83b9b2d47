import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, row long, size int"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table of (id, text, source); columns with clashing names come along."""

    def make(rows):
        full = [(i, t, "en", s, None if t is None else len(t), 7, 8, 9) for i, t, s in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make
