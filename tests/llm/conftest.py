import pytest

HARD = [
    (0, None), (1, ""), (2, " \n\t "), (3, "one two three"), (4, "one two three"), (5, "a" * 70_000), (6, "wörd " * 3000),
    (7, "İstanbul ΑΣ 漢字 😀 \x1c <|endoftext|> it's 12  34\t\t5..,x"), (8, "line one is here\nline one is here\n\nline two is here"), (None, "no id"), (3, "one two three"),
]


@pytest.fixture(scope="session")
def hard(spark):
    """Nulls, empty and long texts, repeated rows, odd characters, and columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en", None if i == 2 else f"s{(i or 0) % 2}", "k", 1) for i, t in HARD], "doc_id long, text string, lang string, source string, key string, fp int")


@pytest.fixture(scope="session")
def empty(hard):
    return hard.limit(0)
