"""Rows that are hard: nulls, empty and long texts, repeated rows, extra columns with clashing names."""

from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def doc(i, text, lang="en", source="s0"):
    return (i, text, lang, source, None if text is None else len(text))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every odd case; the last two rows are one repeated."""
    rows = [
        doc(1, None), doc(2, ""), doc(3, " \t\n"), doc(4, "One two three four five six seven eight nine ten eleven"), doc(5, "Ünï ÇODÉ 123 ¡tEXT! \x00 \U0001f600"),
        doc(6, "word " * 30_000), doc(None, "no id here", None, None), doc(7, "same rows again", None, None), doc(7, "same rows again", None, None),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def sample(spark):
    """The smallest of the given tables."""
    import os

    from tests.conftest import DATA

    if not os.path.isdir(DATA):
        pytest.skip("the tables are not here")
    return spark.read.parquet(f"{DATA}/documents.parquet")
