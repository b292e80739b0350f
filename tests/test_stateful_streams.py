"""Replay in event time: the streams equal the batch for any order of arrival."""
import datetime as dt
import os
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import PACKET_SCHEMA, SF, packet
from flowlens.operators import chains as ch
from flowlens.operators import flows as fl
from flowlens.sources import fixtures as fx
from flowlens.streaming import flow_state as fs
from flowlens.streaming import rollups as ro
from flowlens.streaming import state as st
from flowlens.streaming.runner import read_stream, run_available_now

T0 = dt.datetime(2024, 1, 1)
REQUEST = "id long, ts timestamp, src string, dst string, dst_port long, risk long"


def _stream(spark, df, path, part):
    """One file after the other, by `part`."""
    df.withColumn("part", part).repartition(1).write.partitionBy("part").parquet(path)
    for i, d in enumerate(sorted(x for x in os.listdir(path) if x.startswith("part="))):
        for f in os.listdir(os.path.join(path, d)):
            os.utime(os.path.join(path, d, f), (time.time() - 900 + i * 60,) * 2)
    return read_stream(spark, path + "/*", df.schema, max_files_per_trigger=1)


def _cache(spark, rows, parts, tmp_path, **options):
    """Requests through the stream, and a last one that moves the watermark on."""
    end = (10**9, max(r[1] for r in rows) + dt.timedelta(days=30), "end", "end", 0, 0)
    df = spark.createDataFrame([*rows, end], REQUEST)
    number = F.create_map(*[F.lit(x) for k, v in enumerate(parts) for i in v for x in (i, k)])
    stream = _stream(spark, df, str(tmp_path / "in"), F.coalesce(number[F.col("id")], F.lit(len(parts))))
    out = str(tmp_path / "out")
    run_available_now(stream, lambda d: st.decision_cache_stream(d, **options), out, checkpoint=str(tmp_path / "ck"))
    got = spark.read.parquet(out).select("id", "ts", "cached", "writer_id", "served_risk")
    want = ch.decision_cache(df.where("src <> 'end'")).select("id", "ts", "cached", "writer_id", "served_risk")
    return sorted(map(tuple, got.collect())), sorted(map(tuple, want.collect()))


def test_cache_out_of_order_equal_times_and_expiry(spark, tmp_path):
    """Requests of a key over three files in no order, within the watermark: at
    the same time, at 299 s and 300 s, at 3,599 s and 3,600 s after the write."""
    s = [0, 299, 300, 300, 599, 600, 700, 1000, 4299, 4600, 4600]
    risk = [25, 90, 70, 1, 5, 30, 99, 3, 50, 60, 61]
    rows = [(i, T0 + dt.timedelta(seconds=x), "a", "b", 1, r) for i, (x, r) in enumerate(zip(s, risk))]
    rows += [(100 + i, T0 + dt.timedelta(seconds=x), "a", "c", 1, 5) for i, x in enumerate([3600, 0, 3599, 7200])]
    got, want = _cache(spark, rows, [[4, 1, 7, 100, 10], [3, 0, 9, 5, 102], [2, 6, 8, 101, 103]], tmp_path, watermark="3 hours")
    assert got == want and len(got) == len(rows)


def test_cache_drops_late_rows_only(spark, tmp_path):
    rows = [(1, T0, "a", "b", 1, 50), (2, T0 + dt.timedelta(minutes=30), "x", "y", 1, 50),
            (3, T0 + dt.timedelta(minutes=31), "x", "y", 1, 50), (4, T0 + dt.timedelta(seconds=10), "a", "b", 1, 50),
            (5, T0 + dt.timedelta(minutes=29), "a", "b", 1, 50)]
    got, want = _cache(spark, rows, [[1, 2], [3], [4, 5]], tmp_path, watermark="10 minutes")
    assert got == [r for r in want if r[0] != 4]


def test_cache_of_decisions_and_hit_counts(spark, tmp_path):
    d = fx.decisions(spark, SF).select("id", "ts", "src", "dst", "dst_port", "risk")
    rows = [tuple(r) for r in d.collect()]
    got, want = _cache(spark, rows, [[r[0] for r in rows if r[0] % 3 == k] for k in range(3)], tmp_path,
                       watermark="1 day", width_ms=60_000)
    assert got == want
    end = (10**9, max(r[1] for r in rows) + dt.timedelta(days=30), "end", "end", 0, 0)
    stream = _stream(spark, spark.createDataFrame([*rows, end], REQUEST), str(tmp_path / "in2"), F.col("id") % 2)
    out = str(tmp_path / "out2")
    run_available_now(stream, lambda x: st.hit_counts(st.decision_cache_stream(x, watermark="1 day", width_ms=60_000)),
                      out, checkpoint=str(tmp_path / "ck2"))
    total = {r.status: r.n for r in spark.read.parquet(out).groupBy("status").agg(F.sum("count").alias("n")).collect()}
    assert total == {r.status: r["count"] for r in ro.cache_counts(ch.decision_cache(d)).collect()}


def test_cache_replay_of_a_bucket_without_a_stream():
    """One key, one bucket of very many requests; writes at and after expiry."""
    cache = st.DecisionCache(3_600_000_000, 300_000_000, 20)
    t = np.arange(0, 1_000_000_000, 1000)
    rows = pd.DataFrame({"t_us": t, "id": np.arange(len(t)), "risk": np.full(len(t), 50)})
    out, entry = cache.replay(("a", "b", 1), rows, None)
    assert (~out.cached).sum() == 4 and entry[0] == 900_000_000 and out.writer_id.iloc[300_000] == 300_000
    out, entry = cache.replay(("a", "b", 1), rows.iloc[:2].assign(t_us=entry[0] + entry[1] - 1 + np.arange(2)), entry)
    assert out.cached.tolist() == [True, False]


def _flows(spark, packets, tmp_path, part, **options):
    end = packets.agg(F.max("ts_us")).first()[0]
    last = spark.createDataFrame([packet(10**9, end / fl.US + 7_776_000, "end", 1, "end", 2)], PACKET_SCHEMA)
    cols = [c.strip().split()[0] for c in PACKET_SCHEMA.split(",")]
    df = packets.select(cols).unionByName(last)
    stream = _stream(spark, df, str(tmp_path / "in"), F.when(F.col("packet_no") == 10**9, 99).otherwise(part))
    out = str(tmp_path / "out")
    run_available_now(stream, lambda d: fs.flow_stream(d, **options), out, checkpoint=str(tmp_path / "ck"))
    return spark.read.parquet(out)


def test_flow_stream_equals_batch_flows(spark, tmp_path):
    """All columns of F5-F10 (no active limit in reach), packets in no order."""
    p = fx.packets(spark, SF)
    got = _flows(spark, p, tmp_path, F.col("packet_no") % 3, idle_timeout=120.0, active_timeout=1e6, watermark="30 days",
                 width_ms=3_600_000)
    want = fl.build_flows(p, idle_timeout=120.0)
    got = got.select(*want.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


@pytest.mark.parametrize("width_ms", [1000, 3_600_000])
def test_flow_stream_with_active_timeout_equals_batch_chain(spark, tmp_path, width_ms):
    """Gaps at and over the idle limit, packets at the active limit, chained."""
    rng = random.Random(9)
    at, t = [], 0.0
    for _ in range(260):
        t += rng.choice([0.0, 0.5, 7.0, 20.0, 60.0, 120.0, 120.000001, 500.0])
        at.append(t)
    rows = [packet(i, x, *(("1.1.1.1", 5, "2.2.2.2", 80) if i % 3 else ("2.2.2.2", 80, "1.1.1.1", 5)), length=40 + i)
            for i, x in enumerate(at)]
    p = spark.createDataFrame(rows, PACKET_SCHEMA)
    got = _flows(spark, p, tmp_path, F.col("packet_no") % 4, idle_timeout=120.0, active_timeout=300.0, watermark="30 days",
                 width_ms=width_ms)
    s = fl.sessionize(fl.canonical_key(p), 120.0)
    sub = ch.active_split(s, 300.0, key_cols=[*fl.KEY, "sid"])
    want = sub.groupBy("ip1", "sub").agg(F.min("ts_us"), F.max("ts_us"), F.count(F.lit(1)), F.sum("pkt_len"))
    got = got.select("src_ip", "first_packet", "start_us",
                     (F.col("start_us") + F.round(F.col("flow_duration") * fl.US).cast("long")).alias("end"),
                     "packet_count_total", "byte_count_total")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
