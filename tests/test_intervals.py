"""Narrowest range over an address: nesting, touching bounds, crowded networks."""
import random

from pyspark.sql import functions as F

from flowlens.operators import intervals as iv


def brute(x, ranges):
    over = [(hi - lo, lo, name) for lo, hi, name in ranges if x is not None and lo <= x <= hi]
    return min(over)[2] if over else None


def check(spark, numbers, ranges, **options):
    df = spark.createDataFrame(list(enumerate(numbers)), "id long, x long").repartition(3)
    r = spark.createDataFrame(ranges, "lo long, hi long, name string")
    got = iv.narrowest_range(df, F.col("x"), r, **options)
    assert got.columns == ["id", "x", "range"]
    rows = got.collect()
    assert sorted((g.id, g.x) for g in rows) == list(enumerate(numbers))
    for g in rows:
        assert (g.range.name if g.range else None) == brute(g.x, ranges), (g, brute(g.x, ranges))


RANGES = [(0, 2**32 - 1, "all"), (10 << 24, (11 << 24) - 1, "ten"), (10 << 24, (10 << 24) + 255, "ten-first"),
          ((10 << 24) + 7, (10 << 24) + 7, "host"), ((11 << 24) - 256, (11 << 24) - 1, "ten-last"), (11 << 24, (11 << 24) + 9, "next")]


def test_nested_ranges_and_bounds(spark):
    at = sorted({b + d for lo, hi, _ in RANGES for b in (lo, hi) for d in (-1, 0, 1)})
    check(spark, [None, *at], RANGES)
    check(spark, [None, *at], RANGES[1:], slices=4)


def test_one_hot_network_and_one_hot_address(spark):
    rng = random.Random(2)
    xs = [(10 << 24) + rng.randint(0, 65535) for _ in range(500)] + [(10 << 24) + 7] * 300 + [(10 << 24) + 256] * 200
    xs += [rng.randint(0, 2**32 - 1) for _ in range(100)]
    for slices in (2, 16, 64):
        check(spark, xs, RANGES, slices=slices)


def test_random_nets(spark):
    rng = random.Random(8)
    nets = {}
    for _ in range(60):
        bits = rng.randint(4, 30)
        lo = (rng.randint(0, 2**16) << 16) >> bits << bits
        nets[lo, lo + 2**bits - 1] = f"{lo}/{32 - bits}"
    ranges = [(lo, hi, name) for (lo, hi), name in nets.items()]
    xs = [rng.choice([lo, hi, (lo + hi) // 2, hi + 1, max(0, lo - 1)]) for lo, hi, _ in ranges for _ in range(5)]
    check(spark, xs, ranges, slices=8)


def test_nothing(spark):
    check(spark, [], RANGES)
    check(spark, [5, None, 5], [])
    assert "CartesianProduct" not in iv.narrowest_range(
        spark.range(9), F.col("id"), spark.createDataFrame(RANGES, "lo long, hi long, name string")
    )._jdf.queryExecution().toString()
