"""Packets -> bidirectional flows.

Layout of the work, chosen for very large, skewed packet tables:

1. `canonical_key` (F1, F4) is a projection: unordered endpoint pair +
   protocol and a direction flag.
2. `sessionize` (F2, W1, W2) cuts each key's timeline at idle gaps. A window
   over the whole key would put a hot key (a scanner, one busy server) into a
   single task, so the timeline is first split into fixed time buckets: the
   window runs per (key, bucket), and a small per-bucket summary (one row per
   key and bucket) stitches neighbouring buckets back together. The result
   is exactly the whole-timeline rule for any bucket width.
3. `flow_stats` (F5-F10) and `nfstream_stats` (F11) are plain grouped
   aggregates over the session id: algebraic, so Spark combines them
   map-side before the shuffle and no group is ever held in memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.exprs import m_mean, m_std, m_var, moment_aggs, ratio

KEY = ["ip1", "port1", "ip2", "port2", "protocol"]
US = 1_000_000

# fixed values: TCP flag bits
TCP_FLAG_BITS = {"syn": 2, "ack": 16, "fin": 1, "rst": 4, "psh": 8, "urg": 32}
TCP = 6


# ------------------------------------------------------------------ F1 / F4
def canonical_key(packets: DataFrame, key: str = "ip") -> DataFrame:
    """Add ip1, port1, ip2, port2 (unordered pair) and is_fwd.

    key='ip'       : fwd iff src_ip < dst_ip; equal IPs are always 'bwd', so
                     the two directions of a loopback talk are two flows (Q5).
    key='endpoint' : compares (ip, port) tuples; both directions share a key.
    """
    s_ip, d_ip, s_p, d_p = (F.col(c) for c in ("src_ip", "dst_ip", "src_port", "dst_port"))
    if key == "ip":
        fwd = s_ip < d_ip
    elif key == "endpoint":
        fwd = (s_ip < d_ip) | ((s_ip == d_ip) & (s_p <= d_p))
    else:
        raise ValueError(f"key must be 'ip' or 'endpoint', not {key!r}")
    return packets.select(
        "*",
        F.when(fwd, s_ip).otherwise(d_ip).alias("ip1"),
        F.when(fwd, s_p).otherwise(d_p).alias("port1"),
        F.when(fwd, d_ip).otherwise(s_ip).alias("ip2"),
        F.when(fwd, d_p).otherwise(s_p).alias("port2"),
        fwd.alias("is_fwd"),
    )


def _order_struct(order: str) -> Column:
    # `o` orders the packets of a key; `o.ts_us` is always the timestamp
    if order == "time":
        return F.struct(F.col("ts_us").alias("k"), F.col("packet_no").alias("n"), F.col("ts_us").alias("ts_us"))
    if order == "capture":
        return F.struct(F.col("packet_no").alias("k"), F.col("packet_no").alias("n"), F.col("ts_us").alias("ts_us"))
    raise ValueError(f"order must be 'time' or 'capture', not {order!r}")


# ------------------------------------------------------------------ F2 / W1 / W2
def sessionize(keyed: DataFrame, idle_timeout: float | None = 60.0, *,
               key_cols: list[str] | None = None, order: str = "time",
               bucket: float | int | None = None) -> DataFrame:
    """Assign every packet to a flow: a new flow starts iff the gap to the
    previous packet of the same key is strictly greater than `idle_timeout`
    seconds (F2). `idle_timeout=None` keeps one flow per key (Q4).

    Adds: sid (struct of the flow's first packet), gap_us (gap to the previous
    packet of the same flow, any direction), dir_gap_us (gap to the previous
    packet of the same flow and direction; negative gaps -> NULL, F7).

    `bucket` is the width of the time buckets that bound a window partition
    (seconds for order='time', packets for order='capture'); default 3600 s /
    1,000,000 packets. It changes parallelism only, never the result.
    """
    key_cols = list(key_cols or KEY)
    o = _order_struct(order)
    if bucket is None:
        bucket = 3600 if order == "time" else 1_000_000
    width = int(bucket * US) if order == "time" else int(bucket)
    timeout_us = None if idle_timeout is None else int(round(idle_timeout * US))

    df = keyed.withColumn("o", o).withColumn("bkt", F.floor(F.col("o.k") / F.lit(width)).cast("bigint"))

    wb = Window.partitionBy(*key_cols, "bkt").orderBy("o")
    before = wb.rowsBetween(Window.unboundedPreceding, -1)
    upto = wb.rowsBetween(Window.unboundedPreceding, 0)
    prev = F.lag("o").over(wb)
    if timeout_us is None:
        local_start = F.lit(False)
    else:
        local_start = prev.isNotNull() & ((F.col("o.ts_us") - prev["ts_us"]) > F.lit(timeout_us))
    df = df.select(
        "*",
        prev.alias("_prev"),
        local_start.alias("_lstart"),
        F.last(F.when(F.col("is_fwd"), F.col("o")), ignorenulls=True).over(before).alias("_pf"),
        F.last(F.when(~F.col("is_fwd"), F.col("o")), ignorenulls=True).over(before).alias("_pb"),
    ).withColumn("_run_start", F.max(F.when(F.col("_lstart"), F.col("o"))).over(upto))

    # one row per (key, bucket): what a later bucket needs from this one
    summary = df.groupBy(*key_cols, "bkt").agg(
        F.min("o").alias("_first"), F.max("o").alias("_last"),
        F.max(F.when(F.col("_lstart"), F.col("o"))).alias("_last_lstart"),
        F.max(F.when(F.col("is_fwd"), F.col("o"))).alias("_last_f"),
        F.max(F.when(~F.col("is_fwd"), F.col("o"))).alias("_last_b"),
    )
    ws = Window.partitionBy(*key_cols).orderBy("bkt")
    ws_before = ws.rowsBetween(Window.unboundedPreceding, -1)
    prev_last = F.lag("_last").over(ws)
    if timeout_us is None:
        first_is_start = prev_last.isNull()
    else:
        first_is_start = prev_last.isNull() | ((F.col("_first.ts_us") - prev_last["ts_us"]) > F.lit(timeout_us))
    summary = summary.select(
        *key_cols, "bkt", "_first",
        prev_last.alias("_prev_last"),
        first_is_start.alias("_first_start"),
        F.last(F.coalesce(F.col("_last_lstart"), F.when(first_is_start, F.col("_first"))),
               ignorenulls=True).over(ws_before).alias("_carry_start"),
        F.last("_last_f", ignorenulls=True).over(ws_before).alias("_carry_f"),
        F.last("_last_b", ignorenulls=True).over(ws_before).alias("_carry_b"),
    )

    j = df.join(summary, on=[*key_cols, "bkt"], how="inner")
    sid = F.coalesce(F.col("_run_start"), F.when(F.col("_first_start"), F.col("_first")), F.col("_carry_start"))
    prev_any = F.coalesce(F.col("_prev"), F.col("_prev_last"))
    prev_dir = F.when(F.col("is_fwd"), F.coalesce(F.col("_pf"), F.col("_carry_f"))) \
        .otherwise(F.coalesce(F.col("_pb"), F.col("_carry_b")))
    j = j.withColumn("sid", sid)
    gap_any = F.when(prev_any >= F.col("sid"), F.col("o.ts_us") - prev_any["ts_us"])
    gap_dir = F.when(prev_dir >= F.col("sid"), F.col("o.ts_us") - prev_dir["ts_us"])
    out_cols = [c for c in keyed.columns] + ["o", "sid"]
    return j.select(*out_cols, gap_any.alias("gap_us"),
                    F.when(gap_dir >= 0, gap_dir).alias("dir_gap_us"))


def _last_ts(order: str) -> Column:
    """Time of the flow's last packet; its first one is the session id. In time
    order that is a flat maximum, which a hash aggregate can hold."""
    return F.max("o.ts_us") if order == "time" else F.max("o")["ts_us"]


def _flag_count(bit: int, where: Column | None = None) -> Column:
    hit = (F.col("protocol") == TCP) & ((F.col("flags").bitwiseAND(F.lit(bit))) != 0)
    if where is not None:
        hit = hit & where
    return F.count_if(hit)


# ------------------------------------------------------------------ F5-F10
def flow_stats(sessions: DataFrame, *, key_cols: list[str] | None = None,
               min_packets: int = 1, order: str = "time") -> DataFrame:
    """Per-flow record of the packet-level flow builder (F5-F10); `order` as
    given to `sessionize`.

    Directions follow the key order (F4). Population std/variance (F6);
    IAT lists per direction, 'total' = both lists together (F7); flag counts
    over TCP packets only (F8); mean TTL / mean non-zero TCP window truncated
    to int, -1 if none (F9); rates and ratios 0 on a zero denominator (F10).
    """
    key_cols = list(key_cols or KEY)
    fwd = F.col("is_fwd")
    length = F.col("pkt_len")
    gap = F.col("dir_gap_us")
    agg = sessions.groupBy(*key_cols, "sid").agg(
        _last_ts(order).alias("_last_us"),
        F.count_if(fwd).alias("packet_count_fwd"),
        F.count_if(~fwd).alias("packet_count_bwd"),
        F.count(F.lit(1)).alias("packet_count_total"),
        F.coalesce(F.sum(F.when(fwd, length)), F.lit(0)).alias("byte_count_fwd"),
        F.coalesce(F.sum(F.when(~fwd, length)), F.lit(0)).alias("byte_count_bwd"),
        F.min(length).alias("packet_length_min"), F.max(length).alias("packet_length_max"),
        *moment_aggs(length, "len", small=True),
        *moment_aggs(F.when(fwd, gap), "gf"), *moment_aggs(F.when(~fwd, gap), "gb"),
        *moment_aggs(gap, "gt"),
        F.min(gap).alias("_gmin"), F.max(gap).alias("_gmax"),
        *[_flag_count(TCP_FLAG_BITS[f]).alias(f"{f}_flag_count") for f in ("syn", "ack", "fin", "rst", "psh")],
        F.avg("ttl").alias("_ttl"),
        F.avg(F.when((F.col("protocol") == TCP) & (F.col("win") != 0), F.col("win"))).alias("_win"),
    )
    if min_packets > 1:
        agg = agg.where(F.col("packet_count_total") >= min_packets)
    return flow_columns(agg, key_cols)


def flow_columns(agg: DataFrame, key_cols: list[str]) -> DataFrame:
    """Counts and moments of flows, from `flow_stats` or a stream -> the record."""
    dur = ((F.col("_last_us") - F.col("sid.ts_us")) / F.lit(float(US)))
    zero = F.lit(0.0)
    iat = {
        "mean_iat_fwd": m_mean("gf", US), "mean_iat_bwd": m_mean("gb", US), "mean_iat_total": m_mean("gt", US),
        "std_iat_fwd": m_std("gf", US), "std_iat_bwd": m_std("gb", US), "std_iat_total": m_std("gt", US),
        "min_iat_total": F.col("_gmin") / F.lit(float(US)), "max_iat_total": F.col("_gmax") / F.lit(float(US)),
    }
    return agg.select(
        F.col("ip1").alias("src_ip"), F.col("ip2").alias("dst_ip"),
        F.col("port1").alias("src_port"), F.col("port2").alias("dst_port"),
        *[c for c in key_cols if c not in KEY],
        "protocol",
        F.timestamp_micros(F.col("sid.ts_us")).alias("timestamp"),
        F.col("sid.ts_us").alias("start_us"),
        dur.alias("flow_duration"),
        "packet_count_fwd", "packet_count_bwd", "packet_count_total",
        F.col("byte_count_fwd").cast("bigint").alias("byte_count_fwd"),
        F.col("byte_count_bwd").cast("bigint").alias("byte_count_bwd"),
        (F.col("byte_count_fwd") + F.col("byte_count_bwd")).cast("bigint").alias("byte_count_total"),
        "packet_length_min", "packet_length_max",
        m_mean("len").alias("packet_length_mean"), m_std("len").alias("packet_length_std"),
        m_var("len").alias("packet_length_variance"),
        *[F.coalesce(e, zero).alias(c) for c, e in iat.items()],
        ratio("packet_count_total", dur, "zero").alias("packets_per_second"),
        ratio(F.col("byte_count_fwd") + F.col("byte_count_bwd"), dur, "zero").alias("bytes_per_second"),
        ratio("byte_count_fwd", "byte_count_bwd", "zero").alias("byte_ratio"),
        ratio("packet_count_fwd", "packet_count_bwd", "zero").alias("packet_ratio"),
        ratio("byte_count_bwd", "byte_count_fwd", "zero").alias("down_up_ratio"),
        *[f"{f}_flag_count" for f in ("syn", "ack", "fin", "rst", "psh")],
        F.coalesce(F.col("_ttl").cast("bigint"), F.lit(-1)).cast("bigint").alias("ttl"),
        F.coalesce(F.col("_win").cast("bigint"), F.lit(-1)).cast("bigint").alias("window_size"),
    )


def build_flows(packets: DataFrame, *, key: str = "ip", idle_timeout: float | None = 60.0,
                min_packets: int = 1, order: str = "time", bucket=None) -> DataFrame:
    """F1 -> F2 -> F5-F10 in one chain."""
    return flow_stats(sessionize(canonical_key(packets, key), idle_timeout, order=order, bucket=bucket),
                      min_packets=min_packets, order=order)


# ------------------------------------------------------------------ F11
def nfstream_stats(sessions: DataFrame, *, key_cols: list[str] | None = None, order: str = "time") -> DataFrame:
    """NFStream-shaped column families over three scopes.

    bidirectional = all packets (gaps interleaved), src2dst = key direction,
    dst2src = reverse. Sizes in bytes, gaps and times in milliseconds.
    """
    key_cols = list(key_cols or KEY)
    fwd = F.col("is_fwd")
    ms = F.lit(1000.0)
    scopes = {"bidirectional": None, "src2dst": fwd, "dst2src": ~fwd}
    aggs = [_last_ts(order).alias("_last_us")]
    derived = []
    for name, cond in scopes.items():
        def w(c, cond=cond):
            return c if cond is None else F.when(cond, c)
        gap = w(F.col("gap_us") if cond is None else F.col("dir_gap_us"))
        ln = w(F.col("pkt_len"))
        aggs += [
            (F.count(F.lit(1)) if cond is None else F.count_if(cond)).alias(f"{name}_packets"),
            F.coalesce(F.sum(ln), F.lit(0)).cast("bigint").alias(f"{name}_bytes"),
            F.min(ln).alias(f"{name}_min_ps"), F.max(ln).alias(f"{name}_max_ps"),
            *moment_aggs(ln, f"{name}_ps", small=True),
            F.min(gap).alias(f"_{name}_gmin"), F.max(gap).alias(f"_{name}_gmax"),
            *moment_aggs(gap, f"{name}_iat"),
            *[_flag_count(bit, cond).alias(f"{name}_{f}_packets") for f, bit in TCP_FLAG_BITS.items()],
        ]
        derived += [
            (f"{name}_mean_ps", m_mean(f"{name}_ps")), (f"{name}_stddev_ps", m_std(f"{name}_ps")),
            (f"{name}_min_iat", F.col(f"_{name}_gmin") / ms), (f"{name}_mean_iat", m_mean(f"{name}_iat", 1000.0)),
            (f"{name}_stddev_iat", m_std(f"{name}_iat", 1000.0)), (f"{name}_max_iat", F.col(f"_{name}_gmax") / ms),
        ]
    agg = sessions.groupBy(*key_cols, "sid").agg(*aggs)
    keep = [c for c in agg.columns if c not in (*key_cols, "sid") and not c.startswith("_")]
    return agg.select(
        F.col("ip1").alias("src_ip"), F.col("ip2").alias("dst_ip"),
        F.col("port1").alias("src_port"), F.col("port2").alias("dst_port"), "protocol",
        F.floor(F.col("sid.ts_us") / F.lit(1000)).cast("bigint").alias("bidirectional_first_seen_ms"),
        F.floor(F.col("_last_us") / F.lit(1000)).cast("bigint").alias("bidirectional_last_seen_ms"),
        ((F.col("_last_us") - F.col("sid.ts_us")) / ms).alias("bidirectional_duration_ms"),
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) if c.endswith(("_min_ps", "_max_ps")) else F.col(c)
          for c in keep],
        *[F.coalesce(e, F.lit(0.0)).alias(n) for n, e in derived],
    )
