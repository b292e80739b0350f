"""Derived per-flow features over NFStream-shaped flows.

Each step is a `DataFrame -> DataFrame` projection; `extract_all` chains them
with `DataFrame.transform`, so Catalyst collapses the chain into one
whole-stage-codegen projection with no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.exprs import ratio

# fixed values: VPN ports of the full feature pipeline and of the light one (Q16)
VPN_PORTS_FULL = [1194, 1723, 500, 4500, 51820, 443, 1701]
VPN_PORTS_LIGHT = [1194, 1723, 500, 4500, 51820]
ENCRYPTION_ENTROPY = 7.5
BUSINESS_HOURS = (9, 17)


def _get(df: DataFrame, name: str, default=0):
    return F.col(name) if name in df.columns else F.lit(default)


def connection_identifiers(df: DataFrame) -> DataFrame:
    """flow_id = src:sp-dst:dp-proto."""
    if "flow_id" in df.columns:
        return df
    return df.withColumn("flow_id", F.format_string("%s:%s-%s:%s-%s", "src_ip", "src_port", "dst_ip",
                                                    "dst_port", "protocol"))


def flow_statistics(df: DataFrame, ratio_rule: str = "numerator") -> DataFrame:
    """Counts, bytes, duration (s), rates, ratios, bulk/active/idle proxies,
    variance = std^2 and cv (C18). `ratio_rule` pins Q1 ('numerator' here)."""
    g = lambda n, d=0: _get(df, n, d)
    d = df.withColumns({
        "packet_count_fwd": g("src2dst_packets"), "packet_count_bwd": g("dst2src_packets"),
        "packet_count_total": g("bidirectional_packets"),
        "byte_count_fwd": g("src2dst_bytes"), "byte_count_bwd": g("dst2src_bytes"),
        "byte_count_total": g("bidirectional_bytes"),
        "flow_duration": g("bidirectional_duration_ms") / F.lit(1000.0),
    })
    d = d.withColumns({
        "packets_per_second": ratio("packet_count_total", "flow_duration", "zero"),
        "bytes_per_second": ratio("byte_count_total", "flow_duration", "zero"),
        "byte_ratio": ratio("byte_count_fwd", "byte_count_bwd", ratio_rule),
        "packet_ratio": ratio("packet_count_fwd", "packet_count_bwd", ratio_rule),
        "down_up_ratio": ratio("byte_count_bwd", "byte_count_fwd", "zero"),
    })
    std_ps, mean_ps = g("bidirectional_stddev_ps"), g("bidirectional_mean_ps", 1)
    return d.withColumns({
        "fwd_bulk_rate": F.col("bytes_per_second") * 0.5,
        "bwd_bulk_rate": F.col("bytes_per_second") * 0.5,
        "active_mean": g("bidirectional_mean_iat"), "active_std": g("bidirectional_stddev_iat"),
        "idle_mean": g("bidirectional_max_iat") * 0.5, "idle_std": g("bidirectional_stddev_iat"),
        "packet_length_variance": std_ps * std_ps,
        "packet_length_cv": F.when(mean_ps > 0, std_ps / mean_ps).otherwise(F.lit(0.0)),
    })


def packet_size_features(df: DataFrame) -> DataFrame:
    """min/max/mean/std of sizes and normal-approximation quartiles (C20)."""
    g = lambda n: _get(df, n, 0)
    d = df.withColumns({"packet_length_min": g("bidirectional_min_ps"), "packet_length_max": g("bidirectional_max_ps"),
                        "packet_length_mean": g("bidirectional_mean_ps"),
                        "packet_length_std": g("bidirectional_stddev_ps")})
    m, s = F.col("packet_length_mean"), F.col("packet_length_std")
    return d.withColumns({"packet_length_q1": m - 0.675 * s, "packet_length_q2": m,
                          "packet_length_q3": m + 0.675 * s})


def timing_features(df: DataFrame) -> DataFrame:
    """IAT per direction and overall, jitter, rtt proxies, periodicity, bursts."""
    g = lambda n: _get(df, n, 0)
    d = df.withColumns({
        "mean_iat_fwd": g("src2dst_mean_iat"), "std_iat_fwd": g("src2dst_stddev_iat"),
        "min_iat_fwd": g("src2dst_min_iat"), "max_iat_fwd": g("src2dst_max_iat"),
        "mean_iat_bwd": g("dst2src_mean_iat"), "std_iat_bwd": g("dst2src_stddev_iat"),
        "min_iat_bwd": g("dst2src_min_iat"), "max_iat_bwd": g("dst2src_max_iat"),
        "flow_iat_mean": g("bidirectional_mean_iat"), "flow_iat_std": g("bidirectional_stddev_iat"),
    })
    m, s = F.col("flow_iat_mean"), F.col("flow_iat_std")
    return d.withColumns({
        "iat_total": m, "jitter": s, "rtt_mean": m, "rtt_std": s,
        "periodicity_score": F.when(s > 0, m / s).otherwise(F.lit(0.0)),
        "burst_rate": _get(d, "packets_per_second", 0), "inter_burst_time": m,
    })


def tcp_features(df: DataFrame, failed: str = "fwd_rst") -> DataFrame:
    """Flag counts per direction, SYN rate, failed connections, SYN-ACK delay
    proxy (C22). failed='fwd_rst' (full pipeline) or 'any_rst' (Q17)."""
    g = lambda n: _get(df, n, 0)
    d = df.withColumns({
        "fwd_syn_packets": g("src2dst_syn_packets"), "bwd_syn_packets": g("dst2src_syn_packets"),
        "fwd_ack_packets": g("src2dst_ack_packets"), "fwd_fin_packets": g("src2dst_fin_packets"),
        "fwd_rst_packets": g("src2dst_rst_packets"), "fwd_psh_packets": g("src2dst_psh_packets"),
        "fwd_urg_packets": g("src2dst_urg_packets"),
    })
    failed_col = F.col("fwd_rst_packets") if failed == "fwd_rst" else \
        F.col("fwd_rst_packets") + g("dst2src_rst_packets")
    return d.withColumns({
        "connection_rate": ratio("fwd_syn_packets", "flow_duration", "zero"),
        "failed_connections": failed_col,
        "syn_ack_delay": _get(d, "flow_iat_mean", 0) * 0.1,
    })


def vpn_features(df: DataFrame, vpn_ports=VPN_PORTS_FULL) -> DataFrame:
    """Port hint, entropy and encryption flag (C23). Keeps a measured
    `entropy_score` when present instead of resetting it (Q3)."""
    ent = _get(df, "entropy_score", 0.0).cast("double")
    return df.withColumns({
        "protocol_hint": F.col("dst_port").isin(list(vpn_ports)).cast("int"),
        "entropy_score": F.coalesce(ent, F.lit(0.0)),
        "encryption_detected": (F.coalesce(ent, F.lit(0.0)) > ENCRYPTION_ENTROPY).cast("int"),
        "tls_version": F.lit(None).cast("string"), "cipher_suite": F.lit(None).cast("string"),
    })


def time_of_day_score(first_seen_ms) -> F.Column:
    """UTC fractional hour in [9, 17] -> 0.0 else 0.5."""
    hour = F.pmod(F.col(first_seen_ms) / F.lit(1000.0) / F.lit(3600.0), F.lit(24.0)) \
        if isinstance(first_seen_ms, str) else F.pmod(first_seen_ms / 3600000.0, F.lit(24.0))
    lo, hi = BUSINESS_HOURS
    return F.when((hour >= lo) & (hour <= hi), F.lit(0.0)).otherwise(F.lit(0.5))


def behavioral_features(df: DataFrame) -> DataFrame:
    """Copies and neutral constants of the behavioural block."""
    g = lambda n: _get(df, n, 0)
    tod = time_of_day_score("bidirectional_first_seen_ms") if "bidirectional_first_seen_ms" in df.columns \
        else F.lit(0.0)
    return df.withColumns({
        "login_failure_rate": F.lit(0.0), "account_velocity": g("packets_per_second"),
        "session_duration": g("flow_duration"), "request_frequency": g("packets_per_second"),
        "connection_establishment_rate": g("connection_rate"), "human_score": F.lit(0.5),
        "bot_probability": F.lit(0.0), "anomaly_score": F.lit(0.0), "reputation_change": F.lit(0.0),
        "time_of_day_score": tod,
    })


def label_placeholders(df: DataFrame) -> DataFrame:
    return df.withColumns({"app_label": F.lit("Unknown"), "intent_label": F.lit("Unknown"),
                           "vpn_flag": F.lit(0)})


def extract_all(df: DataFrame, *, vpn_ports=VPN_PORTS_FULL, ratio_rule: str = "numerator",
                failed: str = "fwd_rst") -> DataFrame:
    """The ordered composition C10 -> C18 -> C20 -> C21 -> C22 -> C23 -> C24."""
    return (df.transform(connection_identifiers)
              .transform(flow_statistics, ratio_rule)
              .transform(packet_size_features)
              .transform(timing_features)
              .transform(tcp_features, failed)
              .transform(vpn_features, vpn_ports)
              .transform(behavioral_features)
              .transform(label_placeholders))


def light_flow_statistics(df: DataFrame) -> DataFrame:
    """Lighter variant of the flow block (C19): when only bidirectional totals
    exist, each direction is taken as half of them; ratios fall back to the
    numerator (Q1)."""
    g = lambda n: _get(df, n, None)
    tp, tb = F.col("bidirectional_packets"), F.col("bidirectional_bytes")
    d = df.withColumns({
        "packet_count_total": tp, "byte_count_total": tb,
        "packet_count_fwd": F.coalesce(g("src2dst_packets"), tp / 2),
        "packet_count_bwd": F.coalesce(g("dst2src_packets"), tp / 2),
        "byte_count_fwd": F.coalesce(g("src2dst_bytes"), tb / 2),
        "byte_count_bwd": F.coalesce(g("dst2src_bytes"), tb / 2),
        "flow_duration": F.col("bidirectional_duration_ms") / F.lit(1000.0),
    })
    return d.withColumns({
        "packets_per_second": ratio("packet_count_total", "flow_duration", "zero"),
        "bytes_per_second": ratio("byte_count_total", "flow_duration", "zero"),
        "byte_ratio": ratio("byte_count_fwd", "byte_count_bwd", "numerator"),
        "packet_ratio": ratio("packet_count_fwd", "packet_count_bwd", "numerator"),
    })


# fixed values (C29): port categories
SYSTEM_PORTS_BELOW = 1024
REGISTERED_PORTS_BELOW = 49152


def documented_features(df: DataFrame) -> DataFrame:
    """Documented extra features (C29): byte asymmetry, is_tcp / is_udp,
    destination-port category, burst score = packets/s over the global mean
    (one aggregate; the mean comes back as a single number)."""
    mean_pps = df.agg(F.avg("packets_per_second")).first()[0] or 0.0
    fwd, bwd = F.col("byte_count_fwd"), F.col("byte_count_bwd")
    port = F.col("dst_port")
    return df.withColumns({
        "asymmetry": F.when(fwd + bwd > 0, (fwd - bwd) / (fwd + bwd)).otherwise(F.lit(0.0)),
        "is_tcp": (F.col("protocol") == 6).cast("int"), "is_udp": (F.col("protocol") == 17).cast("int"),
        "port_category": F.when(port < SYSTEM_PORTS_BELOW, F.lit("system"))
                          .when(port < REGISTERED_PORTS_BELOW, F.lit("registered")).otherwise(F.lit("dynamic")),
        "burst_score": F.col("packets_per_second") / F.lit(mean_pps) if mean_pps else F.lit(0.0),
    })
