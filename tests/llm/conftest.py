import pytest

from tests.compare import SMALL, database


@pytest.fixture(scope="session")
def con():
    return database()


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture()
def docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns with clashing names."""
    rows = [
        (1, "one two three four five six seven", "en", 1), (2, "", "en", 2), (3, None, None, None), (None, "a line without an id, long enough to count", "en", 4),
        (4, "one two three four five six seven", "en", 1), (4, "one two three four five six seven", "en", 1), (5, "word " * 30_000, "en", 5), (6, "é ß 漢字 \U0001f600 x", "de", 6),
    ]
    names = "doc_id long, text string, score string, fp int"
    return spark.createDataFrame(rows, names).withColumnsRenamed({}).selectExpr("*", "1 AS n_words", "2 AS component_id", "3 AS length", "4 AS _h", "5 AS h1")


@pytest.fixture()
def none(docs):
    return docs.limit(0)
