from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows of documents from texts, with extra columns whose names operators use inside."""

    def make(texts, first: int = 0):
        rows = [(first + i, t, "en", "s", None, -1, "d", 7) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, run int, digest string, size int")

    return make


@pytest.fixture(scope="session")
def odd_texts() -> list:
    """Nulls, empties, blanks, repeats, one long word, many words, rare letters."""
    words = " ".join(f"w{i % 977}" for i in range(20_000))
    return [None, "", " \t\n", "one", "one", "One two three four five six", "one  two three\tfour five six", "x" * 30_000, words, words, words + " end", "Straße 漢字 \U0001f600 Σς İ", "a" * 99, "a" * 250]
