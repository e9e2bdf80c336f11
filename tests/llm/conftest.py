from __future__ import annotations

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    return (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )


ODD = [
    (1, "The quick brown fox\njumps over the lazy dog", "en", "a"),
    (2, None, "en", None),
    (3, "", None, "a"),
    (4, "  \t\n ", "en", "b"),
    (None, "no id here", "en", "b"),
    (5, "The quick  brown fox\njumps over the lazy dog", "en", "a"),
    (5, "The quick  brown fox\njumps over the lazy dog", "en", "a"),
    (7, "漢字 é 👍 'll don't 123", None, "c"),
    (8, "x" * 200_000 + " tail " + "word " * 30_000, "en", "a"),
    (9, "The quick brown fox\njumps over the lazy dog", "de", None),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns with the operators' own names."""
    rows = [(*r, 0 if r[1] is None else len(r[1]), "extra", 1.5, [1]) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, size double, ids array<int>").repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
