import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from conftest_rows import ODD  # noqa: E402


@pytest.fixture(scope="session")
def documents(spark):
    """A builder of documents with an extra column whose name clashes with names used inside."""

    def build(rows, lang="en"):
        rows = [(i, t, lang, "src0", len(t or ""), "x") for i, t in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, body string")

    return build




@pytest.fixture(scope="session")
def odd(documents):
    """Nulls in each column, empty and very long texts, repeated rows and ids, hostile patterns."""
    return documents(ODD)
