import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


@pytest.fixture
def docs(spark):
    """Documents from (id, text) pairs; a third item is the source."""
    def make(rows):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCS)
    return make


ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (4, "one"), (None, "Two words"), (5, "two WORDS"),
       (6, "a b c d e f"), (7, "x " * 30_000), (8, "é ü 中文 😀 ﬁ▁ y"), (None, None)]


@pytest.fixture
def odd(docs):
    """Nulls, empty, blank and very long texts, repeated rows, null ids."""
    return docs(ODD)
