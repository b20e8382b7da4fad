import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def odd_docs(spark):
    """Nulls in any column, empty and long texts, repeated rows, a repeated id, columns with clashing names."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [(1, "a short text here", "en", "s", 3), (2, None, None, None, None), (3, "", "en", None, 0), (4, long, "de", "s", 1), (5, "a short text here", None, "s", 3), (5, "a short text here", None, "s", 3), (6, "!!! ???\n\n  ", "fr", "s", 9), (None, "no id at all", "en", "s", 1), (7, "x", "en", "s", 1)]
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], DOCS + ", key string, score string, _row int")


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
