"""Small tables with the cases that every operator must stand."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, h string, vector int"


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source); the last columns' names clash with those inside operators."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or ""), "x", "y", 1) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture
def docs(spark):
    return lambda rows: documents(spark, rows)


@pytest.fixture
def edge(spark):
    """Nulls in every column, an empty text, one without words, a very long one, ties and repeated rows."""
    long = "lorem ipsum dolor " * 30_000
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, long), (5, "same text here"), (6, "same text here"), (5, "same text here"), (None, "no id"), (None, None, None, None), (7, "Ünïcödé 漢字 😀 \u0000 end", None, None)]
    return documents(spark, rows)


@pytest.fixture
def empty(spark):
    return documents(spark, [])
