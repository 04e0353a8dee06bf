from __future__ import annotations

import pytest

AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today."),
    (2, "the QUICK brown fox jumps over the lazy dog near the old river bank today."),
    (2, "the QUICK brown fox jumps over the lazy dog near the old river bank today."),
    (3, None),
    (4, ""),
    (None, "a row without an id"),
    (5, " \t\n\x0b\x0c\r "),
    (6, "x" * 5000),
    (7, "Ärger über Öl — naïve café, 東京 🙂 " * 3),
    (8, "word " * 400_000),
    (9, "a row without an id"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of `(id, text)` or `(id, text, source)` rows."""

    def make(rows):
        full = [
            (r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows
        ]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def awkward(docs_of):
    """Nulls, empty and very long texts, ties, repeated rows and a missing id."""
    return docs_of(AWKWARD)


@pytest.fixture(scope="session")
def labels_of(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality long, toxic long")
