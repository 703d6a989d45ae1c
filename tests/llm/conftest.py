"""Tables of awkward rows that every operator must take."""

from __future__ import annotations

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, Shard string, `count` long"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and
    columns whose names clash with those of results."""
    long = " ".join(f"word{k % 977}" for k in range(60_000))
    rows = [
        (1, "one two three four five six seven eight", "en", "src1", 39, "x", 1),
        (1, "one two three four five six seven eight", "en", "src1", 39, "x", 1),
        (2, "one two three four five six seven eight", "en", "src2", 39, "y", 1),
        (3, "", "en", "src1", 0, None, None),
        (4, None, None, None, None, None, None),
        (None, "one two three four five six seven eight", "fr", "src3", 39, None, 2),
        (None, None, None, None, None, None, None),
        (5, long, "en", "src1", len(long), "z", 3),
        (6, long + " end", "de", None, len(long) + 4, "z", 3),
        (7, " \n\t ", "de", "src2", 4, "z", 3),
        (8, "Mail a.b+c@mail.example.com or 10.0.0.255, call +1 (202) 555-0143, pay 4111 1111 1111 1111.", "en", "src1", 90, "", 0),
        (9, "öäü ÖÄÜ 😀 naïve", "de", "src9", 16, "", 0),
    ]
    return spark.createDataFrame(rows, DOCUMENTS)


@pytest.fixture(scope="session")
def sf(spark):
    return "/root/testdata/sf0.01"
