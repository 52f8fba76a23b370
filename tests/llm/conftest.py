import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, score string, ids string, __hash string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties, columns that clash with results."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    rows = [
        (1, "The same text here for all of us to read", "en", "a", 10, 1, "s", "i", "h"),
        (2, "The same text here for all of us to read", None, None, None, None, None, None, None),
        (2, "The same text here for all of us to read", None, None, None, None, None, None, None),
        (3, "The  same text\there for all of us\nto read", "en", "b", 1, 2, "s", "i", "h"),
        (4, None, "en", "a", 0, 0, "", "", ""), (5, "", None, "a", 0, 0, "", "", ""), (6, " \n\t ", "de", "a", 4, 0, "", "", ""),
        (None, "A text without an id, long enough for several shingles", "fr", "c", 5, 5, "x", "y", "z"),
        (None, None, None, None, None, None, None, None, None),
        (7, long, "en", "a", len(long), 0, "", "", ""), (8, long + " end", "en", "a", 1, 0, "", "", ""),
        (9, "é ß ñ 漢字 😀 <|endoftext|> don't it's", "xx", "a", 1, 0, "", "", ""),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
