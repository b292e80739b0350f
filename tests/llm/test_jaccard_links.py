import collections

import numpy as np

from flowlens.llm import jaccard_rtree as jr

from .conftest import ODD
from .test_jaccard_rtree import brute, near_copies, shingles


def check(docs, rows):
    sets = [shingles(t) for _, t in rows]
    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
    got = jr.jaccard_links(docs(rows)).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)
    want = collections.Counter((k, len(s), c) for (k, _), s, c in zip(rows, sets, links))
    assert collections.Counter((r.doc_id, r.n_shingles, r.n_links) for r in got) == want


def test_every_link_between_different_texts_counts(docs, monkeypatch):
    monkeypatch.setattr(jr, "BLOCK", 16)  # a component in several tiles
    monkeypatch.setattr(jr, "DENSE", 40)
    rows = near_copies(90, 60, 5, 4) + near_copies(12, 300, 30, 5, 1000)
    check(docs, rows + [(5000 + i, rows[i][1]) for i in range(0, 90, 7)])  # classes of several rows too


def test_odd_rows_and_empty_table(docs):
    check(docs, ODD)
    assert jr.jaccard_links(docs([])).count() == 0


def test_overlaps_equal_plain_ones(monkeypatch):
    rnd = np.random.default_rng(0)
    one, two = ([np.unique(rnd.integers(0, 300, rnd.integers(0, 200))) for _ in range(k)] for k in (23, 17))
    want = [[len(np.intersect1d(a, b)) for b in two] for a in one]
    for dense, at_once in ((0, 10), (20, 50), (1 << 13, 1 << 22)):
        monkeypatch.setattr(jr, "DENSE", dense)
        monkeypatch.setattr(jr, "AT_ONCE", at_once)
        assert jr._overlaps(one, two).tolist() == want
