import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make(spark):
    """Documents from texts, or from (doc_id, text) pairs, with clashing extra columns."""

    def build(texts, lang="en", extra=True):
        rows = [t if isinstance(t, tuple) else (k, t) for k, t in enumerate(texts)]
        schema = DOCS + (", node long, id string, h string, fp string, key string, words string, rank string, n string" if extra else "")
        return spark.createDataFrame([(i, t, lang, f"src{i}", None if t is None else len(t), *((7, "x", None, "y", "k", "w", "r", "n") if extra else ())) for i, t in rows], schema)

    return build


