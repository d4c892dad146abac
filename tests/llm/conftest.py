import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, out string, k long, t string, gone int"

#: Nulls in every column, empty and long texts, repeated rows, one id with two texts, clashing extra columns.
ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta", "en", "s0", 35, "r", "o", 5, "t", 1),
    (2, "", "en", "s1", 0, None, None, None, None, None),
    (3, None, None, None, None, None, None, None, None, None),
    (4, " \n\t ", "de", "s2", 4, "r", "o", 5, "t", 1),
    (5, "ALPHA beta gamma delta epsilon zeta", "en", "s3", 35, "r", "o", 5, "t", 1),
    (5, "ALPHA beta gamma delta epsilon zeta", "en", "s3", 35, "r", "o", 5, "t", 1),
    (6, "word " * 30_000, "en", "s4", 150_000, "r", "o", 5, "t", 1),
    (7, "x" * 50_000, None, "s5", 50_000, "r", "o", 5, "t", 1),
    (8, "one\ntwo\n\none\n", "fr", "s6", 13, "r", "o", 5, "t", 1),
    (None, "no id at all, but a text 😀 é", "fr", "s7", 28, "r", "o", 5, "t", 1),
    (None, None, None, None, None, None, None, None, None, None),
    (9, "1234 !!! 5678", "fr", None, 13, "r", "o", 5, "t", 1),
    (10, "two texts of one id", "en", "s8", 19, "r", "o", 5, "t", 1),
    (10, "another text of it", "en", "s8", 18, "r", "o", 5, "t", 1),
    (11, "it's <|endoftext|> we'll 's x  y\n\n z", "en", "s9", 35, "r", "o", 5, "t", 1),
]


@pytest.fixture(scope="session")
def odd(spark):
    """A small table of awkward documents."""
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    """The same columns without rows."""
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
