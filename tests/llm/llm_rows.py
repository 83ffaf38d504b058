"""Small frames with the awkward rows every operator must take, and comparing frames."""

from __future__ import annotations

import pytest

# names that operators use for columns of their own
CLASHES = ["_sum", "_bytes", "_dropped", "_sha", "_chars", "log_ppl", "log_ppl_low", "log_ppl_limit", "_text"]
LONG = "alpha beta gamma delta " * 3000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing extra columns."""
    rows = [
        (1, "one two three four five six seven", "en"),
        (2, "one two three four five six seven", None),
        (2, "one two three four five six seven", None),
        (3, "", "en"),
        (4, None, None),
        (None, "a row without an id and some words", "de"),
        (None, None, None),
        (5, LONG, "en"),
        (6, " \t\n ", "fr"),
        (7, "été 日本語 👍🏽 \u00a0\u2003x", "fr"),
    ]
    wide = [(*r, "x", 1, 2.5, "USER", *CLASHES) for r in rows]
    schema = "doc_id long, text string, lang string, keep_id string, n int, score double, keep string"
    schema += "".join(f", {name} string" for name in CLASHES)
    return spark.createDataFrame(wide, schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


def rows_of(df, *columns):
    """Rows as sorted tuples, nulls first."""
    got = [tuple(r) for r in df.select(*columns).collect()]
    return sorted(got, key=lambda r: [(x is not None, x) for x in r])
