import pytest

from tests.conftest import spark  # noqa: F401

#: Nulls in each column, empty and blank texts, repeated rows, ties, a long word, and a column that clashes with names in use.
ROWS = [
    (5, "The cat sat on the mat and the dog sat on the log", "en", "a"),
    (3, "The cat  sat on the mat\tand the dog sat on the log", "en", "a"),
    (9, "The cat sat on the mat and the dog sat on the log!", None, None),
    (1, "", "en", "b"), (2, None, "de", "b"), (4, " \n\t ", None, "b"), (7, "12 34 ...", "en", "b"),
    (8, "der Hund und die Katze sind im Haus und der Garten ist schön", "de", "a"),
    (8, "der Hund und die Katze sind im Haus und der Garten ist schön", "de", "a"),
    (None, "a null id has a text of its own here", "en", None),
    (11, "x" * 3000, None, "c"), (12, "spam spam spam spam spam $$$ LOUD!! | | |", "en", "c"),
    (13, "ab " * 4000, "en", "c"),
]


@pytest.fixture(scope="session")
def odd(spark):  # noqa: F811
    frame = spark.createDataFrame([(*r, i) for i, r in enumerate(ROWS)], "doc_id long, text string, lang string, source string, fp int")
    return frame.selectExpr("*", "'kept' AS digest", "1.0D AS score", "'x' AS language", "0 AS number")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
