from __future__ import annotations

import pytest

#: Nulls in any column, empty and wordless texts, copies, repeated rows, and clashing column names.
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away", "en", "a", 57, "x"),
    (2, "the quick brown fox jumps over the lazy dog and runs away", "en", "a", 57, "y"),
    (2, "the quick brown fox jumps over the lazy dog and runs away", "en", "a", 57, "y"),
    (3, None, None, None, None, None),
    (4, "", "fr", "b", 0, ""),
    (5, "... 123 !!! —", "de", "b", 13, "z"),
    (None, "le chat est sur la table avec le chien et la souris", "fr", None, 51, "id"),
    (7, "été à l'école où çà et là 🙂 " * 40, "fr", "c", 1200, "q"),
    (8, "word " * 3000, "en", "c", 15000, "q"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
