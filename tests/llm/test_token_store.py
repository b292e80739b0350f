import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowlens.llm import token_store as ts
from flowlens.llm.text import utf8
from flowlens.session import Scratch

from .conftest import ODD

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def plain(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [ts.END_ID]


def test_ids_equal_the_library(monkeypatch):
    rnd = random.Random(5)
    letters = "abcAZéÉß 'sIİΣσ.,!?\t\n\x1c\x85\xa0 ́é12ﬁ<|>😀中Kक़"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30))) for _ in range(5000)]
    texts += ["it's we'll <|endoftext|> x", "ΑΣ ΑΣ.", None, "", "a" * 5000]
    for size in (ts.CACHE, 50):  # also with a cache that overflows
        monkeypatch.setattr(ts, "CACHE", size)
        for at in range(0, len(texts), 500):
            part = texts[at:at + 500]
            ids, stops = ts.ids_of(PATH).encode(*utf8(pa.array(part)), ts.END_ID)
            for k, text in enumerate(part):
                assert ids[stops[k]:stops[k + 1]].tolist() == plain(text), repr(text)


@pytest.fixture
def store(spark):
    scratch = Scratch(spark, "test-store")
    yield scratch
    scratch.keep_only()


def test_index_from_the_files(spark, docs, store):
    rows = [(i * 13 % 501, f"Word {i} and {i % 7} more, " * (i % 9)) for i in range(501)]
    ts.write_store(docs(rows), store.path("s"), PATH)
    got = {r.doc_id: r for r in ts.store_index(spark, store.path("s")).collect()}
    at = 0
    for k, text in sorted(rows):
        ids = plain(text)
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    some = ts.select_documents(spark, store.path("s"), F.col("doc_id").between(10, 12))
    assert {r.doc_id: r.ids for r in some.collect()} == {k: plain(t) for k, t in rows if 10 <= k <= 12}
    assert "PushedFilters: [IsNotNull(doc_id)" in some._jdf.queryExecution().toString()


def test_odd_rows_and_empty_table(spark, odd, docs, store):
    ts.write_store(odd, store.path("odd"), PATH)
    got = ts.store_index(spark, store.path("odd")).orderBy("start").collect()
    assert len(got) == len(ODD)
    assert [r.start for r in got] == np.append(0, np.cumsum([r.n_tokens for r in got]))[:-1].tolist()
    ts.write_store(docs([]), store.path("none"), PATH)
    assert ts.store_index(spark, store.path("none")).count() == 0
