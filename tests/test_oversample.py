"""SMOTE (D10): exact neighbours in any cells, class sizes, places of the new rows."""
import collections
import random

import numpy as np

from flowlens.operators import oversample as ov
from flowlens.session import Scratch

POINT = "cls string, pid string, x array<double>"


def brute(points, k):
    out = {}
    for c, p, x in points:
        near = sorted((sum((a - b) ** 2 for a, b in zip(x, y)), q) for d, q, y in points if d == c and q != p)
        out[p] = [q for _, q in near[:k]]
    return out


def test_neighbours_are_exact_over_many_cells(spark):
    """Clusters of different density, ties on a grid, chunks of crowded cells."""
    rng = random.Random(3)
    xs = {(float(rng.randint(0, 12)), float(rng.randint(0, 12)), 0.0) for _ in range(150)}
    xs |= {(rng.gauss(50, 0.5), rng.gauss(50, 9), rng.random()) for _ in range(250)}
    points = [("a", f"p{i:04d}", list(x)) for i, x in enumerate(sorted(xs))]
    points += [("b", f"q{i}", [float(i * i), 0.0, 0.0]) for i in range(4)] + [("c", "r", [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(points, POINT).repartition(3)
    for cell, chunk in ((20, 10), (400, 64)):
        got = {r.pid: list(r.near) for r in ov.nearest_in_class(df, 5, Scratch(spark, "t"), cell=cell, chunk=chunk).collect()}
        assert got == brute(points, 5)


def _rows():
    rng = random.Random(1)
    rows = [(i, "big", rng.random(), rng.random()) for i in range(400)]
    rows += [(1000 + i, "small", rng.gauss(5, 1), 7.0) for i in range(30)]
    rows += [(2000 + i, "same", 1.0, 2.0) for i in range(12)]  # one point
    rows += [(3000, "lone", -1.0, 3.0), (4000, None, 1.0, 1.0), (4001, "small", None, 1.0), (4002, "enough", 1.0, 1.0)]
    return rows + [(5000 + i, "enough", float(i), 0.0) for i in range(99)]


def test_classes_reach_the_ratio_between_neighbours(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "id long, y string, a double, b double")
    got = ov.smote(df, "y", ["id"], ["a", "b"], target_ratio=0.2, k=3).collect()
    size = collections.Counter(r[1] for r in rows if r[1] is not None and r[2] is not None)
    made = collections.Counter(r.y for r in got)
    assert made == {c: 80 - size[c] for c in ("small", "same", "lone")}
    assert all((r.a, r.b) == (1.0, 2.0) for r in got if r.y == "same")
    assert all((r.a, r.b) == (-1.0, 3.0) for r in got if r.y == "lone")
    small = {r[0]: r for r in rows if r[1] == "small" and r[2] is not None}
    per_row = collections.Counter(r.id for r in got if r.y == "small")
    assert set(per_row.values()) == {1, 2} and set(per_row) == set(small)
    for r in got:
        if r.y == "small":
            near = sorted(abs(s[2] - small[r.id][2]) for s in small.values() if s[0] != r.id)[:3]
            assert abs(r.a - small[r.id][2]) <= near[-1] + 1e-9 and r.b == 7.0
    again = ov.smote(df.repartition(5), "y", ["id"], ["a", "b"], target_ratio=0.2, k=3, cell=4, chunk=5).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_nothing_to_do(spark):
    df = spark.createDataFrame([], "id long, y string, a double")
    assert ov.smote(df, "y", ["id"], ["a"]).count() == 0
    df = spark.createDataFrame([(1, "u", 1.0), (2, "v", 2.0)], "id long, y string, a double")
    assert ov.smote(df, "y", ["id"], ["a"]).count() == 0


def test_distances_sum_from_the_first_feature():
    a, b = np.array([[0.1, 0.2, 0.3]]), np.array([[1.7, -2.9, 1e9]])
    assert ov.squared_distances(a, b)[0, 0] == ((0.1 - 1.7) ** 2 + (0.2 + 2.9) ** 2) + (0.3 - 1e9) ** 2
