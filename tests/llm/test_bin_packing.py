import collections
import random

import numpy as np
from pyspark.sql import functions as F

from flowlens.llm import bin_packing as bp

from .conftest import ODD


def plain(items, capacity):
    """(bin, place) of each item by trying all bins in order of room, then number."""
    bins, out = [], []
    for size, s, c in items:
        fits = [b for b in bins if b[0] >= size and not b[2] & s and not b[3] & c]
        best = min(fits, key=lambda b: (b[0], b[1]), default=None)
        if best is None:
            best = [capacity, len(bins), 0, 0]
            bins.append(best)
        out.append((best[1], capacity - best[0]))
        best[0] -= size
        best[2] |= s
        best[3] |= c
    return out


def test_equals_a_full_search():
    for seed in range(30):
        rnd = random.Random(seed)
        items = sorted(((rnd.randint(1, 50), 1 << rnd.randrange(5), rnd.choice([0, 1 << rnd.randrange(60)]))
                        for _ in range(300)), reverse=True)
        n, s, c = (np.array(x) for x in zip(*items))
        bins, places = bp.best_fit(n, s, c, 64)
        assert list(zip(bins.tolist(), places.tolist())) == plain(items, 64)


def check(df, rows, capacity=20, shard=50, cluster=None):
    got = bp.pack(df, capacity=capacity, shard=shard).collect()
    total = collections.Counter()
    for r in got:
        total[r.doc_id] += r.n_tokens
    want = collections.Counter()
    for row in rows:
        want[row[0]] += len((row[1] or "").split()) + 1
    assert total == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.bin_id].append(r)
    for pieces in bins.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.bin_start):
            assert r.bin_start == at
            at += r.n_tokens
        assert at <= capacity
    return got, bins


def test_sources_and_copies_keep_apart(docs):
    rnd = random.Random(1)
    rows = [(i, "w " * rnd.randint(0, 45) + str(i % 40), f"s{rnd.choice([0, 0, i % 9])}") for i in range(300)]
    got, bins = check(docs(rows), rows)
    source = {r[0]: r[2] for r in rows}
    copies = {r[0]: r[1].lower() for r in rows}
    for pieces in bins.values():
        ids = [r.doc_id for r in pieces]
        assert len({source[i] for i in ids}) == len(ids) == len({copies[i] for i in ids})
    assert sorted(map(tuple, bp.pack(docs(rows).repartition(7), capacity=20, shard=50).collect())) == sorted(map(tuple, got))


def test_pieces_cover_long_texts(docs):
    got, _ = check(docs([(1, "w " * 99)]), [(1, "w " * 99)])
    assert sorted((r.piece, r.piece_start, r.n_tokens) for r in got) == [(i, 20 * i, 20) for i in range(5)]


def test_odd_rows_and_empty_table(odd, docs):
    check(odd, [(k, (t or "").replace("▁", "_")) for k, t in ODD])
    assert bp.pack(docs([])).count() == 0
    none = docs([(1, "a"), (2, "b")]).withColumn("source", F.lit(None).cast("string"))
    assert len({r.bin_id for r in bp.pack(none).collect()}) == 1  # no source, no conflict
