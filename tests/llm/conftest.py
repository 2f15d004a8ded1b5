import pytest

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with nulls, an empty text, ties, repeated rows, and columns whose names operators use inside."""
    rows = [
        (1, "a b c d e f", "en", "s", 11), (2, "a b c d e f", "en", "s", 11), (3, None, None, None, None), (4, "", "en", "s", 0), (None, "a b c d e f", "en", None, 11),
        (7, "x " * 50_000, "de", "t", 100_000), (8, "MIT License and Apache License", "en", "t", 30), (8, "MIT License and Apache License", "en", "t", 30), (9, "other words are here", None, "t", 20),
    ]
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", "1 AS h", "2 AS sha", "3 AS maybe", "'x' AS fp", "0 AS gone", "true AS kept", "5 AS Top")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
