"""Drift states, merged and compared, against plain counts."""

import math
import random

import pytest
from pyspark.sql import functions as F

from flowlens.operators import drift as dr


def _cells(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    rows = df.select("i", dr.cell(F.col("x")).alias("k")).withColumn("low", dr.cell_floor(F.col("k"))).orderBy("i").collect()
    return [r.k for r in rows], [r.low for r in rows]


def test_cells_are_ordered_and_narrow(spark):
    rng = random.Random(3)
    values = sorted([rng.uniform(-1, 1) * 10 ** rng.randint(-3, 11) for _ in range(400)] + [-0.001, 0.0, 0.001, 0.063, 0.064])
    k, low = _cells(spark, values)
    assert k == sorted(k)
    for v, f in zip(values, low):
        assert abs(f) <= abs(v) + 1e-9 and abs(v) - abs(f) <= max(1 / dr.UNIT, abs(v) / 32) + 1e-9


def test_odd_values(spark):
    k, _ = _cells(spark, [None, float("nan"), float("inf"), float("-inf"), 1e300, -0.0, 0.0])
    assert k[:2] == [None, None] and k[2] == k[4] == -k[3] - 1 and k[5] == k[6] == 0


def test_merged_states_equal_the_state_of_all_rows(spark):
    df = spark.range(0, 2000).select((F.col("id") % 7).alias("day"), (F.col("id") * 1.7).alias("x"),
                                     F.when(F.col("id") % 5 > 0, F.col("id") % 13).alias("odd name"))
    whole = dr.feature_state(df, ["x", "odd name"])
    daily = dr.feature_state(df, ["x", "odd name"], ["day"])
    halves = dr.merge_states(daily.where("day < 3"), daily.where("day >= 3"))
    key = lambda r: (r.feature, r.cell is not None, r.cell, r.n)
    assert sorted(map(key, whole.collect()), key=str) == sorted(map(key, halves.collect()), key=str)
    with pytest.raises(ValueError):
        dr.feature_state(df.withColumnRenamed("day", "n"), ["x"], ["n"])


def test_quantiles_are_near_the_exact_ones(spark):
    state = dr.feature_state(spark.range(1, 10_001).select(F.col("id").alias("x")), ["x"])
    got = {r.prob: r.value for r in dr.state_quantiles(state, [0.1, 0.5, 0.99]).collect()}
    assert all(abs(got[p] - p * 10_000) <= p * 10_000 / 32 for p in (0.1, 0.5, 0.99))


def _plain_psi(train, live, bins=10):
    cells = sorted(set(train) | set(live))
    r, q, under = {}, {}, 0
    for c in cells:
        b = min(under * bins // len(train), bins - 1)
        r[b], q[b] = r.get(b, 0) + train.count(c), q.get(b, 0) + live.count(c)
        under += train.count(c)
    share = lambda n, m: max(n / m, dr.EPS)
    return sum((share(q[b], len(live)) - share(r[b], len(train)))
               * math.log(share(q[b], len(live)) / share(r[b], len(train))) for b in r), len(r)


def test_drift_equals_a_plain_count(spark):
    rng = random.Random(5)
    train = [float(rng.choice([0, 0, 0, 1, 2, 5, 9, 30])) for _ in range(300)]
    live = [float(rng.choice([0, 2, 3, 9, 60, 61])) for _ in range(200)]
    k, _ = _cells(spark, train + live)
    states = [dr.feature_state(spark.createDataFrame([(v,) for v in [*side, None]], "x double"), ["x"]) for side in (train, live)]
    row = dr.state_drift(*states).first()
    psi, bins = _plain_psi(k[:300], k[300:])
    assert (row.n_train, row.n_live, row.bins) == (300, 200, bins) and abs(row.psi - psi) < 1e-9 and row.drift_alert
    assert abs(row.missing_train - 1 / 301) < 1e-12 and abs(row.missing_live - 1 / 201) < 1e-12
    same = dr.state_drift(states[0], states[0]).first()
    assert same.psi == 0 and not same.drift_alert


def test_empty_sides_have_no_index(spark):
    one = dr.feature_state(spark.createDataFrame([(1.0, None)], "x double, y double"), ["x", "y"])
    none = dr.feature_state(spark.createDataFrame([], "x double, y double"), ["x", "y"])
    for pair in ((one, none), (none, one)):
        assert all(r.psi is None and not r.drift_alert for r in dr.state_drift(*pair).collect())
    assert dr.state_drift(none, none).count() == 0
    only = {r.feature: r for r in dr.state_drift(one, one).collect()}
    assert only["x"].psi == 0 and only["y"].psi is None and only["y"].missing_live == 1
