"""op8: a pair of points comes out of the first cell that both are in, once."""

import numpy as np

from flowlens.llm import jaccard_rtree as jr

CELLS = {1: [1, 2, 3, 4, 5], 2: [1, 2, 3, 6], -3: [2, 3, 4], 7: [2, 3, 4], 9: [5, 6]}


def _found(spark, spanning, parts=()):
    point = bytearray(jr._point(np.arange(10, dtype=np.uint64)))
    cells = spark.createDataFrame([(h, fp) for h, fps in CELLS.items() for fp in fps], "h long, fp long")
    small = spark.createDataFrame([(fp, 10, point) for fp in range(1, 7)], "fp long, n int, point binary")
    parts = spark.createDataFrame(list(parts), "u long, v long")
    found = jr._search(jr._tiles(cells, parts, small), jr.Rule(75), spanning).select("a", "b").collect()
    return sorted(map(tuple, found))


def _expected(label):
    pairs = {(a, b) for fps in CELLS.values() if len(fps) > 2 for a in fps for b in fps if a < b}
    return sorted(p for p in pairs if label.get(p[0], p[0]) != label.get(p[1], p[1]))


def test_every_pair_once(spark, monkeypatch):
    for block in (1024, 2, 1):
        monkeypatch.setattr(jr, "BLOCK", block)
        assert _found(spark, False) == _expected({})


def test_pairs_of_one_component_stay_out(spark):
    parts = [(2, 1), (3, 1)]
    assert _found(spark, False, parts) == _expected(dict(parts))


def test_spanning_pairs_connect_what_all_pairs_connect(spark, monkeypatch):
    for block in (1024, 2):
        monkeypatch.setattr(jr, "BLOCK", block)
        few, part = _found(spark, True), {fp: fp for fp in range(1, 7)}
        for a, b in few:
            low, high = sorted((part[a], part[b]))
            part = {k: low if v == high else v for k, v in part.items()}
        assert set(part.values()) == {1} and set(few) <= set(_expected({}))


def test_apart():
    sets = [np.array(s, np.int64) for s in ([], [1, 2], [2, 3], [4])]
    assert jr._apart(sets, np.array([0, 1, 1, 2]), np.array([0, 2, 3, 3])).tolist() == [True, False, True, True]
    assert len(jr._apart(sets, np.zeros(0, int), np.zeros(0, int))) == 0


def test_links_do_not_depend_on_blocks(docs, monkeypatch):
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(words[:50 + k])) for k in range(6)] + [(9, "other words entirely here now")]
    found = []
    for block in (1024, 1):
        monkeypatch.setattr(jr, "BLOCK", block)
        found.append(sorted(map(tuple, jr.jaccard_links(docs(rows)).collect())))
    plain = {k: {tuple(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)} for k, t in rows}
    links = {k: sum(100 * len(plain[k] & plain[o]) >= 75 * len(plain[k] | plain[o]) for o in plain if o != k) for k in plain}
    assert found[0] == found[1] and {r[0]: r[3] for r in found[0]} == links
