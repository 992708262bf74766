"""Awkward documents shared by the tests."""

import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"

# Nulls in every column, empty and blank texts, ties, repeated rows, one very long text.
LONG = " ".join(f"word{i * i % 997} of{i % 89}" for i in range(20_000))
BASE = " ".join(f"alpha{i} beta{i * 7 % 31}" for i in range(60))
ODD_ROWS = [
    (1, BASE, "en", "a", 10),
    (2, BASE, None, None, None),
    (3, BASE.upper().replace(" ", "\n\t"), "en", "a", 1),
    (4, BASE.replace("alpha30", "omega"), "en", "a", 1),
    (5, None, "en", "a", 0),
    (6, "", "en", "a", 0),
    (7, " \n\t ", "en", "a", 4),
    (8, "two words", "en", "a", 9),
    (9, "Two  Words", "en", "a", 10),
    (10, LONG, "en", "b", 1),
    (11, "one", "fr", "b", 3),
    (12, "a   b\n\n  c  ", "fr", "b", 3),
    (13, "x y   z é ü #$% <b>", "de", "b", 3),
    (None, "nobody knows my id " * 30, "de", "b", 3),
    (14, "same row twice " + BASE[:200], "de", "b", 3),
    (14, "same row twice " + BASE[:200], "de", "b", 3),
]


@pytest.fixture
def odd_docs(spark):
    """Documents with awkward rows and extra columns whose names clash with the operators' own."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(ODD_ROWS, DOCUMENTS)
    return rows.withColumns({name: F.lit(1) for name in ("group", "shard", "slot", "size", "length", "score", "_s", "kept", "node", "text_key", "edits_")})


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCUMENTS)
