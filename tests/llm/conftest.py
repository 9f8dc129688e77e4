import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").limit(60).cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, ties, and columns named like those of results."""
    rows = [
        (1, None, "x", 1), (2, "", "x", 2), (3, " \n\t ", "x", 3), (4, "a b c d e f", None, 4), (4, "a b c d e f", None, 4),
        (5, "one", "x", None), (None, "a b c d e f", "x", 6), (6, "word " * 20000, "x", 7), (7, "z" * 30000, "x", 8),
        (8, "É ß 漢字 İ don't 12 345\n\nline\nline", "x", 9), (9, "é \u0001 \x1c tail", "x", 10),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words long")
