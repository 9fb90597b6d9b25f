import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, comp string, _word string"


def table(spark, rows):
    """documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), 1, "x", "y") for i, t, lang, s in rows], SCHEMA)


@pytest.fixture
def docs_of(spark):
    return lambda rows: table(spark, rows)


@pytest.fixture
def prose():
    """Seeded text of ``n`` words out of ``size`` made-up ones."""

    def make(seed, n, size=400):
        r = random.Random(seed)
        return " ".join(f"w{r.randrange(size)}" for _ in range(n))

    return make


@pytest.fixture
def odd_rows(prose):
    """Nulls everywhere, empty and long texts, ties and repeated rows."""
    long_text = prose(99, 30_000, 5000)
    return [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", None), (4, long_text, "en", "a"), (5, long_text, "en", "b"), (None, "a b c d e f", "en", "b"), (6, "one two", None, "a"), (6, "one two", None, "a"), (7, "ONE two", "en", "c"), (8, "é" * 50 + " ünï", "fr", "c")]
