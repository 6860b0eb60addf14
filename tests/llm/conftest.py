import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns with names that operators use inside."""
    long = " ".join(f"word{i % 977}x{i % 13}" for i in range(60_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 1),
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 1),
        (2, "the quick brown fox jumps over the lazy dog again and again", "en", "b", 1),
        (3, "", "en", "a", 0),
        (4, None, None, None, None),
        (None, "a text without an id, secret = abcdef123456", "en", None, 5),
        (5, long, "en", "a", len(long)),
        (6, "   \n\t ", "en", "a", 6),
        (7, "naïve café ünïcode 日本語 😀 token: 'tok_123456'", "fr", "b", 9),
    ]
    df = spark.createDataFrame(rows, DOCS)
    names = ["fp", "rep", "root", "k", "v", "b1", "spans", "hash", "owner", "size", "target", "keep_id", "times_", "id_", "values_", "label", "score", "y", "node", "a", "b", "row_", "live"]
    return df.selectExpr("*", *[f"'x' AS {n}" for n in names])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
