"""Previous value within a key over time buckets, positions of a global sort."""
import datetime as dt
import random

from pyspark.sql import functions as F

from flowlens.functions import parse as ps
from flowlens.operators import detect as de
from flowlens.operators import sequence as sq

T0 = dt.datetime(2024, 1, 1)


def test_previous_value_for_any_bucket(spark):
    """A hot key, a null key, equal times, null values, empty buckets."""
    rng = random.Random(4)
    rows = [(i, rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice(["x", "y", None]), rng.choice([0, 1, 5, 700, 9000]) * i // 50)
            for i in range(300)]
    want, last = {}, {}
    for i, k, v, s in sorted(rows, key=lambda r: (r[3], r[0])):
        want[i] = last.get(k)
        last[k] = v
    df = spark.createDataFrame(rows, "id long, k string, v string, s long")
    for width in (1_000_000, 3_600_000_000, 10**15):
        got = sq.previous_in_key(df, ["k"], "v", F.col("s") * 1_000_000, ["id"], bucket_us=width)
        assert got.columns == ["id", "k", "v", "s", "previous"]
        assert {r.id: r.previous for r in got.collect()} == want


def test_ip_change_rate_of_a_cluster(spark):
    """An account that moves counts in the cluster it moves to."""
    at = [("u", "1.1.1.1", 0), ("u", "2.2.2.2", 10), ("u", "2.2.2.2", 20), ("v", "2.2.2.2", 30), ("u", "1.1.1.1", 40)]
    df = spark.createDataFrame([(i, a, ip, True, "ua", T0 + dt.timedelta(seconds=s)) for i, (a, ip, s) in enumerate(at)],
                               "id long, account string, ip string, success boolean, agent string, ts timestamp")
    moved = sq.previous_in_key(df, ["account"], "ip", F.unix_micros("ts"), ["id"], name="previous_ip")
    got = {r.ip: r.ip_change_rate for r in de.credential_stuffing(moved).collect()}
    assert got == {"1.1.1.1": 0.5, "2.2.2.2": 1 / 3}
    assert "ip_change_rate" not in de.credential_stuffing(df).columns


def _positions(spark, texts, strict):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, timestamp string").repartition(3)
    got = sq.sort_positions(df, "timestamp", ps.parse_ts(F.col("timestamp"), ["yyyy-MM-dd'T'HH:mm:ss"]), ["id"],
                            strict=strict, buckets=4)
    return [r.id for r in sorted(got.collect(), key=lambda r: r.position)]


def test_sort_positions(spark):
    texts = [(T0 + dt.timedelta(seconds=s)).strftime("%Y-%m-%dT%H:%M:%S") for s in (50, 10, 10, 99, 1, 7, 7, 7, 3)]
    texts[3:3] = ["", None]
    order = sorted(range(len(texts)), key=lambda i: (texts[i] or "", i))
    assert _positions(spark, texts, True) == order and _positions(spark, texts, False) == order
    texts[0] = "no time"
    order = sorted(range(len(texts)), key=lambda i: ("" if texts[i] == "no time" else texts[i] or "", i))
    assert _positions(spark, texts, False) == order
    assert _positions(spark, texts, True) == list(range(len(texts)))
    assert _positions(spark, [], True) == [] and _positions(spark, ["", None, ""], True) == [0, 1, 2]
