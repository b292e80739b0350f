"""Decision cache on a live stream.

Per key (src, dst, dst_port) the cache keeps the current entry: write time, TTL
and the written result. Requests are replayed in event time (see `replay`), so
the served results are those of the batch form `operators.chains.decision_cache`
for every request that isn't late, whatever the order of arrival; an entry is
evicted by a timer once its TTL is over.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.operators.chains import LOW_RISK_BELOW, TTL_LOW_RISK_S, TTL_OTHER_S
from flowlens.streaming.replay import EventTimeReplay

CACHE_OUT = ("id long, ts timestamp, src string, dst string, dst_port long, risk long, "
             "cached boolean, writer_id long, served_risk long")
KEY = ["src", "dst", "dst_port"]


class DecisionCache(EventTimeReplay):
    fields = {"t_us": "long", "id": "long", "risk": "long"}
    order = ["t_us", "id"]
    entry = "t_write_us long, ttl_us long, writer_id long, served_risk long"

    def __init__(self, low_ttl_us: int, other_ttl_us: int, low_below: int, width_ms: int = 1000):
        self.low_ttl_us, self.other_ttl_us, self.low_below, self.width_ms = low_ttl_us, other_ttl_us, low_below, width_ms
        self.hold_us = max(low_ttl_us, other_ttl_us)

    def expiry_us(self, entry: tuple) -> int:
        return entry[0] + entry[1]

    def replay(self, key, rows, entry):
        t, risk, ids = (rows[c].to_numpy() for c in ("t_us", "risk", "id"))
        ttl = np.where(risk < self.low_below, self.low_ttl_us, self.other_ttl_us)
        cached = np.ones(len(t), bool)
        writer, served = np.zeros(len(t), np.int64), np.zeros(len(t), np.int64)
        i = 0
        while i < len(t):  # a turn for each write
            if entry is None or t[i] >= entry[0] + entry[1]:
                entry, cached[i] = (int(t[i]), int(ttl[i]), int(ids[i]), int(risk[i])), False
            j = max(i + 1, int(np.searchsorted(t, entry[0] + entry[1], "left")))
            writer[i:j], served[i:j] = entry[2], entry[3]
            i = j
        out = pd.DataFrame({"id": ids, "ts": pd.to_datetime(t, unit="us"), "src": key[0], "dst": key[1],
                            "dst_port": key[2], "risk": risk, "cached": cached, "writer_id": writer,
                            "served_risk": served})
        return out, entry


def decision_cache_stream(requests: DataFrame, *, watermark: str = "1 hour", low_ttl_s: int = TTL_LOW_RISK_S,
                          other_ttl_s: int = TTL_OTHER_S, low_below: int = LOW_RISK_BELOW,
                          width_ms: int = 1000) -> DataFrame:
    """Streaming decision cache (R7): one output row per request, `append`
    mode, once the watermark has passed it. Null keys are keys."""
    r = requests.select("id", "ts", *KEY, "risk", F.unix_micros("ts").alias("t_us")).withWatermark("ts", watermark)
    cache = DecisionCache(low_ttl_s * 1_000_000, other_ttl_s * 1_000_000, low_below, width_ms)
    return r.groupBy(*KEY).transformWithStateInPandas(
        cache, CACHE_OUT, outputMode="Append", timeMode="EventTime", eventTimeColumnName="ts")


def hit_counts(cache_out: DataFrame, width: str = "1 minute") -> DataFrame:
    """Hits and misses by event-time window behind the streaming cache (R6),
    each window once in `append` mode; their sums are `rollups.cache_counts`."""
    status = F.when(F.col("cached"), "hit").otherwise("miss")
    return cache_out.groupBy(F.window("ts", width).alias("w"), status.alias("status")) \
        .agg(F.count(F.lit(1)).alias("count")).select(F.col("w.start").alias("window_start"), "status", "count")
