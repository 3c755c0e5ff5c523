import pytest

from lookalike.llm.common import ship

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from ``(doc_id, text, lang, source)``."""

    def build(rows):
        full = [(i, t, g, s, len(t) if t is not None else None) for i, t, g, s in rows]
        return spark.createDataFrame(full, DOC_SCHEMA)

    return build


@pytest.fixture(scope="session")
def awkward(spark, documents):
    """Nulls in every column, empty and blank texts, repeated rows, a very long text, clashing columns."""
    long = " ".join(f"word{i % 977} tail{i % 31}" for i in range(40_000))
    rows = [
        (1, None, None, None),
        (2, "", "en", "a"),
        (3, " \n\t ", "en", "a"),
        (4, "one two three four five six seven", "en", "b"),
        (4, "one two three four five six seven", "en", "b"),
        (None, "one two three four five six seven", "fr", None),
        (5, long, "en", "a"),
        (6, long + " changed", "en", None),
        (7, "12345 !!!", "de", "b"),
    ]
    df = documents(rows)
    for name in ("key", "fp", "size", "owner", "score", "root", "edits", "_times", "_copy", "taken", "start"):
        df = df.selectExpr("*", f"'x' as {name}")
    return df


@pytest.fixture(scope="session")
def nothing(documents):
    return documents([])
