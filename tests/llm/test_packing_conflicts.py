import random

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowlens.llm import bin_packing as bp
from flowlens.llm.queries import QUERIES, vocabulary

from .conftest import SF


def test_different_sources_share_a_bin(docs):
    rows = [(i, f"word{i}", f"s{i}") for i in range(200)]  # no conflict: 400 tokens, more than 63 documents a bin
    assert len({r.bin_id for r in bp.pack(docs(rows)).collect()}) == 1
    two = [(i, f"word{i}", f"s{i // 2}") for i in range(200)]  # 100 sources of two documents each
    assert len({r.bin_id for r in bp.pack(docs(two)).collect()}) == 2


def test_equals_a_full_search_over_exact_conflicts():
    for seed in range(8):
        rnd = random.Random(seed)
        items = sorted(((rnd.randint(1, 50), rnd.randrange(150), rnd.choice([0, rnd.randrange(-2**62, 2**62), rnd.randrange(1, 90)]))
                        for _ in range(500)), reverse=True)
        bins, want = [], []
        for size, s, c in items:
            fits = [b for b in bins if b[0] >= size and not (s and s in b[2]) and not (c and c in b[3])]
            best = min(fits, key=lambda b: (b[0], b[1]), default=None)
            if best is None:
                best = [200, len(bins), set(), set()]
                bins.append(best)
            want.append((best[1], 200 - best[0]))
            best[0] -= size
            best[2].add(s)
            best[3].add(c)
        got = bp.best_fit(*(np.array(x) for x in zip(*items)), 200)
        assert list(zip(*(x.tolist() for x in got))) == want


def test_lengths_are_those_of_the_token_store(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stored = {r.doc_id: r.n_tokens for r in QUERIES["op5_token_store"](spark, SF).collect()}
    packed = QUERIES["op10_best_fit_packing"](spark, SF).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
    assert {r.doc_id: r.n for r in packed} == stored and len(stored) == docs.count()


def test_texts_without_spaces_fill_sequences(docs):
    rows = [(1, "漢字" * 3000, "a"), (2, "", "b"), (3, None, "c")]
    got = bp.pack(docs(rows), capacity=512, tokenizer=vocabulary("word_bpe_49k.json")).collect()
    of = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    for k, text, _ in rows:
        n = len(of.encode(text or "", add_special_tokens=False).ids) + 1
        assert sum(r.n_tokens for r in got if r.doc_id == k) == n
        assert sorted(r.piece_start for r in got if r.doc_id == k) == list(range(0, n, 512))


def test_null_ids_are_dealt_to_all_shards(docs):
    rows = [(None, f"word{i} " * (i % 7), "s") for i in range(2000)]
    got = bp.pack(docs(rows), capacity=64, shard=100).collect()
    assert len(got) == 2000 and len({r.bin_id.rsplit("-", 1)[0] for r in got}) == 20
