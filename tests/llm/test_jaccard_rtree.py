import collections
import random
import re

import numpy as np
import pytest

from flowlens.llm import jaccard_rtree as jr
from flowlens.llm import text

from .conftest import ODD

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t):
    w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(FOLD))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low = collections.defaultdict(list)
    for i, (k, _) in enumerate(rows):
        low[find(i)].append(k)
    return collections.Counter(
        (k, len(sets[i]), min((x for x in low[find(i)] if x is not None), default=None)) for i, (k, _) in enumerate(rows))


def check(docs, rows):
    got = jr.jaccard_components(docs(rows)).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)


def near_copies(n, words, edits, seed, start=0):
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(5000)}" for _ in range(words)]
    out = []
    for i in range(n):
        copy = list(base)
        for _ in range(rnd.randint(0, edits)):
            copy[rnd.randrange(words)] = f"n{rnd.randrange(10**6)}"
        out.append((start + i, " ".join(copy)))
    return out


def test_groups_of_near_copies(docs):
    rows = near_copies(120, 90, 5, 1) + near_copies(60, 400, 12, 2, 1000) + near_copies(10, 8, 2, 3, 2000)
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(3000 + i, f"{passage} " + " ".join(f"x{i}y{j}" for j in range(10 + i))) for i in range(60)]
    check(docs, rows)


def test_blocks_and_frequent_cells(docs, monkeypatch):
    monkeypatch.setattr(jr, "BLOCK", 16)
    monkeypatch.setattr(jr, "FANOUT", 4)
    check(docs, near_copies(150, 60, 5, 4) + near_copies(40, 1500, 40, 5, 1000))


def test_long_texts_have_more_groups(docs):
    check(docs, near_copies(6, 6000, 120, 6) + near_copies(6, 2500, 60, 7, 100))


def test_odd_rows(odd, docs):
    check(docs, ODD)


def test_empty_table(docs):
    assert jr.jaccard_components(docs([])).count() == 0


def test_bound_is_never_under_the_overlap():
    rnd = np.random.default_rng(2)
    for n in (3, 50, 700, 5000, 300_000):
        a = rnd.integers(0, 2**63, n).astype(np.uint64)
        b = np.unique(np.concatenate([a[: n - n // 8], rnd.integers(0, 2**63, n // 8 + 1).astype(np.uint64)]))
        a = np.unique(a)
        x, y = jr._point(a), jr._point(b)
        g = min(len(x), len(y))
        bound = jr._minima(jr._folded(x[None], g), jr._folded(y[None], g))[0]
        assert bound >= len(np.intersect1d(a, b))


@pytest.mark.parametrize("n", [1, 5, 40, 300])
def test_tree_finds_what_a_full_search_finds(n, monkeypatch):
    monkeypatch.setattr(jr, "FANOUT", 4)
    rnd, rule = np.random.default_rng(n), jr.Rule(75)
    base = rnd.poisson(2, (max(1, n // 5), jr.GROUPS))
    points = np.minimum(255, base[rnd.integers(0, len(base), n)] + rnd.poisson(0.1, (n, jr.GROUPS))).astype(np.uint8)
    sizes = points.sum(1).astype(np.int64)
    tree = jr.RTree(points, sizes)
    got = {(int(a), int(b)) for x, y, _ in tree.pairs(tree, rule) for a, b in zip(x, y)}
    want = {(a, b) for a in range(n) for b in range(n)
            if rule.sizes(sizes[a], sizes[b]) and rule.enough(np.minimum(points[a], points[b]).sum(dtype=np.int64), sizes[a], sizes[b])}
    assert got == want


def test_words_in_windows_equal_plain_ones(monkeypatch):
    import pyarrow as pa
    texts = ["A bc\tdé", "", None, "x" * 50 + " y " + "z" * 40, " \n ", "ab", "cd e"] * 5
    whole = text.words(*text.utf8(pa.array(texts)))
    monkeypatch.setattr(text, "WINDOW", 7)
    small = text.words(*text.utf8(pa.array(texts)))
    assert (whole.hash == small.hash).all() and (whole.first == small.first).all() and (whole.end == small.end).all()
    counts = np.diff(whole.first).tolist()
    assert counts == [len((t or "").split()) for t in texts]
