import pytest

#: Nulls in every column, empty and blank texts, ties, repeated rows, one very long text, and columns whose names clash with results.
EXTRA = "score double, n_hit string, slot string, size long, copies string, component_id string, content string, Text2 string"


@pytest.fixture(scope="session")
def odd_documents(spark):
    from turnwise.llm.common import configure

    configure(spark)
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a"),
        (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a"),
        (2, "the QUICK brown\tfox jumps over the lazy dog near the river bank today", "en", "a"),
        (3, None, None, None),
        (4, "", "de", "b"),
        (5, " \t\n ", "de", "b"),
        (None, "Ein Text ohne Nummer", "de", None),
        (None, None, None, None),
        (6, "x" * 300_000 + " " + "wort " * 60_000, "de", "c"),
        (7, "123 !!! 456", "en", "c"),
        (8, "É ÉCOLE ß 中文 😀 <|endoftext|> İ́", "fr", "c"),
    ]
    rows = [(*r, 1.0, "x", "y", 3, "z", "w", "v", "t") for r in rows]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {EXTRA}")


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)
