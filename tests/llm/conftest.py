import pytest


@pytest.fixture(scope="session")
def text_rows(spark):
    """doc_id, text and source with nulls, an empty and a long text, ties, repeated rows, and columns whose names operators use inside."""
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    rows = [
        (1, "one two three four five six seven eight nine ten", "a"), (2, "one two three four five six seven eight nine ten", "a"), (2, "one two three four five six seven eight nine ten", "a"),
        (3, None, "b"), (4, "", None), (None, "some text without an id", "b"), (5, long, "a"), (6, " \t\n", "c"), (7, "ONE two three four five six seven eight nine ten", "c"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.selectExpr("*", "1 as fp", "'x' as line", "2 as h1", "'y' as host", "3 as score", "text as body", "4 as n_words", "5 as piece", "6 as band", "'z' as `__d`")
