import pytest

LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank texts, a very long one, ties, rows that repeat, and columns that clash with everything inside."""
    rows = [
        (1, "A plain text. It has some words, and a second line.\nThe second line is here, for all to see.", "en", "a", 10),
        (1, "A plain text. It has some words, and a second line.\nThe second line is here, for all to see.", "en", "a", 10),
        (2, None, None, None, None),
        (3, "", "en", "b", 0),
        (4, " \n\t \x0b", "en", "b", 5),
        (5, LONG, "en", "c", len(LONG)),
        (None, "A text without an id, token = abcdef123456, and more words to it.", "de", None, 3),
        (None, None, None, None, None),
        (6, "a b   c \U0001f600 d\x85e", "fr", "\U0001f600", 1),
        (7, "one", "en", "a", 3),
        (-8, "same same same same same same same same same", "en", "a", 4),
    ]
    extra = (1.5, 2, "x", b"y", True, 7, "t", 1)
    df = spark.createDataFrame([(*r, *extra) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, size long, `TEXT` string, key binary, held_out boolean, block int, matches string, taken int")
    return df


@pytest.fixture(scope="session")
def odd_count():
    return 11


@pytest.fixture
def docs(spark):
    return lambda *texts: spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts, 1)], "doc_id long, text string, lang string, source string, n_chars long")
