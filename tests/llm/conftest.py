import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Builds a documents table from texts; ids are their positions unless given."""

    def build(texts, ids=None, extra=""):
        ids = range(len(texts)) if ids is None else ids
        rows = [
            (i, t, "en", "s", None if t is None else len(t)) + ((7,) * extra.count(" long"))
            for i, t in zip(ids, texts)
        ]
        return spark.createDataFrame(rows, DOCS + extra)

    return build
