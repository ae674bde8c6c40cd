import pytest

LONG = " ".join(f"w{i % 97} v{i % 89}" for i in range(20_000))
COPIED = "the quick brown fox jumps over the lazy dog and then it sleeps all day long in the warm sun"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, a repeated id, columns whose names operators use themselves."""
    rows = [
        (1, COPIED, "a"),
        (2, None, "b"),
        (3, "", "c"),
        (None, COPIED, "d"),
        (None, None, None),
        (5, LONG, "e"),
        (6, LONG, "e"),
        (7, COPIED, "f"),
        (7, COPIED, "f"),
        (8, "one", None),
        (8, "another text under the same id", "g"),
        (9, " \t\n ", "h"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    for name in ("doc", "n", "part", "start", "h", "score", "__id", "spans"):
        docs = docs.selectExpr("*", f"'x' AS {name}")
    return docs


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
