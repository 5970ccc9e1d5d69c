import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "alpha beta gamma delta " * 40_000

#: Nulls in every column, an empty text, one of spaces, a very long one, ties and repeated rows.
ROWS = [
    (1, "The cat sat on the mat. " * 6, "en", "a", 100),
    (2, None, "en", "a", None),
    (3, "", None, "b", 0),
    (4, " \t\n ", "en", None, 3),
    (5, LONG, "en", "a", len(LONG)),
    (6, "The cat sat on the mat. " * 6, "en", "a", 100),
    (6, "The cat sat on the mat. " * 6, "en", "a", 100),
    (None, "A row without an id, but with words enough to count.", "en", "c", 52),
    (7, "naïve Ünïcode text — mixed İ scripts 文字 and spaces " * 4, "fr", "c", 1),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).coalesce(2)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def clashing(spark, odd):
    """Columns with the names that operators use for their own."""
    from pyspark.sql import functions as F

    return odd.withColumns({c: F.lit(f"own {c}") for c in ("n_words", "kept", "size", "blob", "fp", "row", "chunk", "copies", "_text", "text_", "spans", "held_out")})
