"""Documented detection analytics (D1-D5, D15), as distributed DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.exprs import m_mean, m_std, moment_aggs
from flowlens.operators import flows as fl
from flowlens.operators.topk import prefix_sums

# fixed values (D1): VPN ports and thresholds of the documented VPN rule
VPN_RULE_PORTS = [1194, 1723, 500, 4500, 51820]
HIGH_ENTROPY = 7.5
LOW_MSS = 1400
# fixed values (D2): MSS fingerprint bands (inclusive) and the VPN cut
MSS_VPN_BELOW = 1440
MSS_VPN_CONFIDENCE = 0.85
MSS_BANDS = [("IPsec", 1340, 1360), ("OpenVPN", 1380, 1409), ("WireGuard", 1420, 1440)]


def vpn_likelihood(df: DataFrame) -> DataFrame:
    """HIGH: entropy > 7.5 on a VPN port; MEDIUM: MSS < 1400 and encrypted;
    else LOW (D1)."""
    high = (F.col("entropy_score") > HIGH_ENTROPY) & F.col("dst_port").isin(VPN_RULE_PORTS)
    med = (F.col("mss") < LOW_MSS) & (F.col("encryption_detected") == 1)
    return df.withColumn("vpn_probability", F.when(high, F.lit("HIGH")).when(med, F.lit("MEDIUM"))
                         .otherwise(F.lit("LOW")))


def mss_fingerprint(df: DataFrame, mss_col: str = "tcp_mss") -> DataFrame:
    """MSS < 1440 -> VPN with confidence 0.85, plus the matching band name."""
    m = F.col(mss_col)
    band = None
    for name, lo, hi in MSS_BANDS:
        band = F.when(m.between(lo, hi), F.lit(name)) if band is None else band.when(m.between(lo, hi), F.lit(name))
    vpn = m < MSS_VPN_BELOW
    return df.withColumns({"mss_vpn": vpn, "mss_vpn_confidence": F.when(vpn, F.lit(MSS_VPN_CONFIDENCE)),
                           "mss_band": band.otherwise(F.lit(None))})


def credential_stuffing(logins: DataFrame, *, window: str = "5 minutes", min_volume: int = 20,
                        max_failure_rate: float = 0.7, ip_col: str = "ip", account_col: str = "account",
                        success_col: str = "success", agent_col: str = "agent", ts_col: str = "ts") -> DataFrame:
    """Clusters = (ip, 5-minute window); features: volume, failure rate,
    account velocity (distinct accounts), agent diversity; flagged when
    failure rate > 0.7 and volume > threshold (D3). Distinct counts are
    exact here; `approx_count_distinct` is the drop-in at very large scale.

    Where `logins` has previous_ip (the address of the account's request before,
    see `sequence.previous_in_key`), the IP change rate is given, too: the share
    of requests whose account came from another address then."""
    changes = []
    if "previous_ip" in logins.columns:
        moved = F.coalesce(F.col("previous_ip") != F.col(ip_col), F.lit(False))
        changes = [F.avg(moved.cast("double")).alias("ip_change_rate")]
    g = logins.groupBy(F.col(ip_col).alias("ip"), F.window(ts_col, window).alias("w")).agg(
        F.count(F.lit(1)).alias("volume"),
        F.avg((~F.col(success_col)).cast("double")).alias("failure_rate"),
        F.count_distinct(account_col).alias("account_velocity"),
        F.count_distinct(agent_col).alias("agents"), *changes)
    return g.select("ip", F.col("w.start").alias("window_start"), "volume", "failure_rate", "account_velocity",
                    *(["ip_change_rate"] if changes else []),
                    (F.col("agents") / F.col("volume")).alias("agent_diversity"),
                    ((F.col("failure_rate") > max_failure_rate) & (F.col("volume") > min_volume)).alias("flagged"))


def beaconing(flows: DataFrame, *, standard_ports=(80, 443), ts_col: str = "start_us") -> DataFrame:
    """Per (src, dst, port) pair: periodicity = 1 - cv of inter-flow gaps,
    persistence = distinct days, size stability (cv of bytes), destination
    diversity of the source, non-standard port flag (D4). Gaps come from the
    flow-building window machinery (time-bucketed, skew-safe)."""
    pair = ["src_ip", "dst_ip", "dst_port"]
    f = flows.select(*pair, F.col(ts_col).alias("ts_us"), F.col("byte_count_total").alias("bytes"),
                     F.xxhash64("src_ip", "dst_ip", "dst_port", ts_col, "byte_count_total").alias("packet_no"))
    k = f.withColumns({"ip1": F.col("src_ip"), "port1": F.lit(0), "ip2": F.col("dst_ip"),
                       "port2": F.col("dst_port"), "protocol": F.lit(0), "is_fwd": F.lit(True)})
    s = fl.sessionize(k, None)  # one timeline per pair; gap_us = gap to the previous flow
    g = s.groupBy(*pair).agg(
        F.count(F.lit(1)).alias("flows"), *moment_aggs(F.col("gap_us"), "gap"), *moment_aggs(F.col("bytes"), "sz"),
        F.count_distinct(F.to_date(F.timestamp_micros("ts_us"))).alias("persistence_days"))
    mg, sg = m_mean("gap"), m_std("gap")
    ms_, ss = m_mean("sz"), m_std("sz")
    div = flows.groupBy("src_ip").agg(F.count_distinct("dst_ip").alias("dst_diversity"))
    return g.join(div, "src_ip", "left").select(
        *pair, "flows", "persistence_days", "dst_diversity",
        F.when(mg > 0, F.greatest(F.lit(0.0), F.lit(1.0) - sg / mg)).otherwise(F.lit(0.0)).alias("periodicity"),
        F.when(ms_ > 0, ss / ms_).otherwise(F.lit(0.0)).alias("size_cv"),
        (~F.col("dst_port").isin(list(standard_ports))).alias("non_standard_port"))


def percent_rank_exact(df: DataFrame, col: str, name: str) -> DataFrame:
    """percent_rank of `col` over the whole table without a single-partition
    window: counts per distinct value, running totals over the value order
    (skew-safe prefix sums), (rank - 1) / (n - 1)."""
    vals = df.groupBy(col).agg(F.count(F.lit(1)).alias("_c"))
    ranked = prefix_sums(vals, [], col, ["_c"], prefix="_lt")
    n = df.count()
    pr = F.when(F.lit(n) > 1, F.col("_lt_c") / F.lit(float(max(n - 1, 1)))).otherwise(F.lit(0.0))
    return df.join(ranked.select(col, pr.alias(name)), on=col, how="left")


def interaction_graph(edges: DataFrame, src: str = "src_ip", dst: str = "dst_ip", volume: str = "byte_count_total") \
        -> DataFrame:
    """Per-IP degrees of the flow graph: fan-in (many-to-one, botnet C&C),
    fan-out (one-to-many, scans), bytes to rare destinations (fan-in 1);
    anomaly score = max of the three percent ranks, 0..1 (D5)."""
    e = edges.select(F.col(src).alias("s"), F.col(dst).alias("d"), F.col(volume).cast("double").alias("v"))
    fan_in = e.groupBy(F.col("d").alias("ip")).agg(F.count_distinct("s").alias("fan_in"))
    fan_out = e.groupBy(F.col("s").alias("ip")).agg(F.count_distinct("d").alias("fan_out"))
    rare = fan_in.where(F.col("fan_in") == 1).select(F.col("ip").alias("d"))
    rare_bytes = e.join(rare, "d", "inner").groupBy(F.col("s").alias("ip")).agg(F.sum("v").alias("rare_bytes"))
    nodes = fan_in.join(fan_out, "ip", "full").join(rare_bytes, "ip", "left").fillna(0)
    nodes = percent_rank_exact(nodes, "fan_in", "pr_in")
    nodes = percent_rank_exact(nodes, "fan_out", "pr_out")
    nodes = percent_rank_exact(nodes, "rare_bytes", "pr_rare")
    return nodes.withColumn("graph_anomaly_score", F.greatest("pr_in", "pr_out", "pr_rare"))


def active_idle(sessions: DataFrame, threshold: float = 1.0, key_cols: list[str] | None = None) -> DataFrame:
    """Active / idle segments inside flows (D15): a second sessionization of
    each flow's packets with `threshold` seconds; busy spans = segment
    durations, quiet spans = the gaps that separate segments. min / mean /
    max / std of both, in seconds (0 when absent)."""
    key = list(key_cols or [*fl.KEY, "sid"])
    inner = sessions.select(*[c for c in sessions.columns if c not in ("o", "dir_gap_us")]) \
        .withColumnRenamed("sid", "flow_sid").withColumnRenamed("gap_us", "flow_gap_us")
    key_inner = [("flow_sid" if c == "sid" else c) for c in key]
    seg = fl.sessionize(inner, threshold, key_cols=key_inner)
    segs = seg.groupBy(*key_inner, "sid").agg((F.max("ts_us") - F.min("ts_us")).alias("active_us"),
                                             F.min(F.struct("o", "flow_gap_us")).alias("_first"))
    # the gap before a segment's first packet is an idle span (NULL for the first segment)
    segs = segs.withColumn("idle_us", F.col("_first.flow_gap_us"))
    us = 1_000_000.0
    out = segs.groupBy(*key_inner).agg(
        F.count(F.lit(1)).alias("segments"),
        F.min("active_us").alias("_amin"), F.max("active_us").alias("_amax"), *moment_aggs(F.col("active_us"), "act"),
        F.min("idle_us").alias("_imin"), F.max("idle_us").alias("_imax"), *moment_aggs(F.col("idle_us"), "idl"))
    z = F.lit(0.0)
    return out.select(
        *[F.col(c).alias("sid" if c == "flow_sid" else c) for c in key_inner], "segments",
        F.coalesce(F.col("_amin") / us, z).alias("min_active"), F.coalesce(m_mean("act", us), z).alias("mean_active"),
        F.coalesce(F.col("_amax") / us, z).alias("max_active"), F.coalesce(m_std("act", us), z).alias("std_active"),
        F.coalesce(F.col("_imin") / us, z).alias("min_idle"), F.coalesce(m_mean("idl", us), z).alias("mean_idle"),
        F.coalesce(F.col("_imax") / us, z).alias("max_idle"), F.coalesce(m_std("idl", us), z).alias("std_idle"))
