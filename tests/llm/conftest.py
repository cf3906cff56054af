import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, ids string, length string, key string, score string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with further columns whose names operators use inside."""

    def make(rows):
        full = [(i, t, None, "s", None, "x", "y", "z", "k", "w") for i, t in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, ties, repeated rows, a very long text, odd white space."""
    long = " ".join(f"word{k % 977} of{k % 31}" for k in range(30_000))
    return [
        (1, "One text, as plain as can be."),
        (2, "one TEXT, as plain as can be."),
        (2, "one TEXT, as plain as can be."),
        (3, None),
        (4, ""),
        (5, "  \t\n "),
        (None, "no id here"),
        (None, None),
        (6, long),
        (7, long + " end"),
        (8, "Ünïcödé  straße \x1c 漢字 🙂 <|endoftext|> áb it's  we'll\r\n\r\nx"),
        (9, "x" * 5000),
    ]


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
