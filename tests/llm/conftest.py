import pytest


@pytest.fixture
def docs(spark):
    """Nulls in every column, empty and blank texts, ties, repeated rows, and columns whose names clash with results."""
    long = " ".join(f"word{i % 977} and" for i in range(30_000))
    rows = [
        (1, "The cat sat on the mat, and the dog ran after it for a while.", "en", "a"), (2, None, "en", "b"), (3, "", None, None), (4, "   \n\t ", "de", "a"), (5, "!!! 123 ???", "en", "c"),
        (6, "The cat sat on the mat, and the dog ran after it for a while.", "en", "a"), (6, "The cat sat on the mat, and the dog ran after it for a while.", "en", "a"), (None, "ohne Nummer geht es auch", "de", None),
        (7, long, "en", "b"), (8, "x", "fr", ""), (9, "tab\tvertical\x0bnul-free é ü 漢字 🙂 <|endoftext|> end", None, "c"), (10, None, None, None),
    ]
    return spark.createDataFrame([(*r, len(r[1] or ""), -1, "x", "y", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, size long, key string, shard string, copies int")


@pytest.fixture
def no_docs(docs):
    return docs.where("false")
