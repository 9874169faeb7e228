import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, id long, hash string, toxic_score double, poor_score string, __met int, __gone int, row long, copies int, Met int"


@pytest.fixture()
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns whose names operators use inside."""
    long = " ".join(f"word{k % 977} of{k % 13}" for k in range(20_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again", "en", "a", 3, 0.5, 7, "h"),
        (1, "the quick brown fox jumps over the lazy dog again", "en", "a", 3, 0.5, 7, "h"),
        (2, None, None, None, None, None, None, None),
        (3, "", "en", "b", 0, 0.1, 1, "x"),
        (4, " \t\n ", "en", "b", 0, 0.1, 1, "x"),
        (None, "the quick brown fox jumps over the lazy dog again", "en", "a", 3, 0.5, 7, "h"),
        (5, "two words", "fr", "c", 9, 0.2, 2, "y"),
        (6, long, "en", None, len(long), 0.3, 3, "z"),
        (8, "x" * 3000 + "0123456789abcdef" * 500, "xx", "a", 5, 0.3, 3, "z"),
        (7, "ünï <|im_end|> 日本 \x00 \U0001f600 ▁", "xx", "a", 5, 0.3, 3, "z"),
    ]
    return spark.createDataFrame([(*r, 0.5, "poor", 1, 2, r[0], 3, None) for r in [rows[5], *rows]], DOCS)


@pytest.fixture()
def no_docs(odd_docs):
    return odd_docs.where("doc_id = 999")
