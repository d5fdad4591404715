import pytest

from tidewell.llm.common import table


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with names that operators use inside."""
    rows = [
        (1, "one two three four five six", "en", 1),
        (1, "one two three four five six", "en", 1),
        (2, None, None, None),
        (3, "", "en", 0),
        (4, " \n\t ", "de", 4),
        (None, "one two three four five six", None, 3),
        (5, "word " * 30_000, "en", 5),
        (6, "x" * 200_000, "en", 6),
        (7, "1234 5678 !!!", "de", 7),
        (8, "mail a.b@c.example, 10.0.0.1 and +1 (988) 555-2485", "de", 8),
    ]
    own = "base candidates discovered doc _row _lang _score _unit _id _spans runs"
    rows = [(*r, r[3], r[3], "class", *[f"{c} {r[0]}" for c in own.split()]) for r in rows]
    schema = "doc_id long, text string, lang string, rank int, length int, start int, class string"
    return spark.createDataFrame(rows, ", ".join([schema, *(f"{c} string" for c in own.split())]))


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
