"""Firewall key=value logs -> unified flow rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.exprs import digits_int
from flowlens.functions.parse import date_time_ts, kv_map
from flowlens.operators.topk import first_per_key
from flowlens.sources.tables import spread

# fixed values: application/service name -> unified app label (J6), default 'Unknown'
APP_LABELS = {
    "DNS": "Browsing", "HTTP": "Browsing", "HTTPS": "Browsing", "QUIC": "Browsing", "SSL": "Browsing",
    "SMB": "File_Transfer", "FTP": "File_Transfer", "SFTP": "File_Transfer", "FTPS": "File_Transfer",
    "SSH": "File_Transfer",
    "SMTP": "Email", "IMAP": "Email", "POP3": "Email", "IMAPS": "Email", "POP3S": "Email",
    "SIP": "VoIP", "STUN": "VoIP", "udp/3478": "VoIP", "tcp/3478": "VoIP",
    "LDAP": "Enterprise_App", "LDAP_UDP": "Enterprise_App", "LDAPS": "Enterprise_App",
    "Kerberos": "Enterprise_App", "NTP": "Enterprise_App",
    "udp/443": "Unknown", "tcp/443": "Browsing",
}
# fixed values: columns a firewall log cannot supply, with their defaults
FIREWALL_DEFAULTS = {
    "packet_length_min": 0, "packet_length_max": 0, "packet_length_std": 0, "packet_length_variance": 0,
    "mean_iat_fwd": 0, "mean_iat_bwd": 0, "mean_iat_total": 0, "std_iat_fwd": 0, "std_iat_bwd": 0,
    "std_iat_total": 0, "min_iat_total": 0, "max_iat_total": 0,
    "syn_flag_count": 0, "ack_flag_count": 0, "fin_flag_count": 0, "rst_flag_count": 0, "psh_flag_count": 0,
    "active_mean": 0, "active_std": 0, "idle_mean": 0, "idle_std": 0,
    "mtu": -1, "mss": -1, "ttl": -1, "window_size": -1, "tcp_options_count": 0,
    "protocol_hint": "Unknown", "encryption_detected": -1, "entropy_score": -1.0,
}
DATASET_SOURCE = "University_FortiAnalyzer"
SUSPICIOUS_CRLEVELS = ["high", "critical"]


def lookup(c: Column, mapping: dict, default) -> Column:
    """Literal map lookup with a default."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    found = F.try_element_at(m, c)
    return found if default is None else F.coalesce(found, F.lit(default))


def parse_lines(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Text lines -> (line columns..., fields MAP); unparsable lines dropped.

    The map is produced by a one-element generator: later filters on the
    parsed fields cannot be pushed below it, so the regex parse runs once per
    line instead of once per field referenced by a filter."""
    return spread(lines).select("*", F.explode(F.array(kv_map(F.col(line_col)))).alias("fields")) \
        .where(F.col("fields").isNotNull())


def to_flow(parsed: DataFrame, source_file: Column | str | None = None) -> DataFrame:
    """Map parsed fields to the unified flow columns.

    Zero-denominator rule: ratios 0. `down_up_ratio` divides by the forward
    bytes, so it is guarded on those (Q2: the reference guards the wrong side
    and loses the whole file on sentbyte=0).
    """
    f = F.col("fields")

    def g(k, default=""):
        return F.coalesce(F.try_element_at(f, F.lit(k)), F.lit(default))

    app, service = g("app"), g("service")
    app_name = F.when((app != "") & ~app.isin("tcp", "udp"), app).otherwise(service)
    action, crlevel, threats = g("action", "accept"), g("crlevel"), g("threats")
    keep = [c for c in parsed.columns if c != "source_file"]
    d = parsed.select(
        *keep,
        g("srcip").alias("src_ip"), g("dstip").alias("dst_ip"),
        digits_int(g("srcport")).alias("src_port"), digits_int(g("dstport")).alias("dst_port"),
        digits_int(g("proto", "0")).alias("protocol"),
        date_time_ts(g("date"), g("time")).alias("timestamp"),
        digits_int(g("sentbyte")).alias("byte_count_fwd"), digits_int(g("rcvdbyte")).alias("byte_count_bwd"),
        digits_int(g("sentpkt")).alias("packet_count_fwd"), digits_int(g("rcvdpkt")).alias("packet_count_bwd"),
        digits_int(g("duration", "0")).alias("flow_duration"),
        lookup(app_name, APP_LABELS, "Unknown").alias("app_label"),
        app_name.alias("service_name"),
        F.when((action == "deny") | crlevel.isin(SUSPICIOUS_CRLEVELS) | (threats != ""), F.lit("Suspicious"))
         .otherwise(F.lit("Benign")).alias("intent_label"),
        g("user", "Unknown").alias("user"), g("group", "Unknown").alias("group"),
        g("srccountry", "Unknown").alias("src_country"), g("dstcountry", "Unknown").alias("dst_country"),
        g("policyname", "Unknown").alias("policy_name"), action.alias("action"),
        F.lit(-1).alias("vpn_flag"), F.lit(DATASET_SOURCE).alias("dataset_source"),
        (F.lit("unknown") if source_file is None else
         (F.col(source_file) if isinstance(source_file, str) else source_file)).alias("source_file"),
        g("sessionid").alias("session_id"),
    ).drop("fields")
    bt = F.col("byte_count_fwd") + F.col("byte_count_bwd")
    pt = F.col("packet_count_fwd") + F.col("packet_count_bwd")
    dur = F.col("flow_duration")
    zero = F.lit(0.0)
    return d.withColumns({
        "byte_count_total": bt, "packet_count_total": pt,
        "packets_per_second": F.when(dur > 0, pt / dur).otherwise(zero),
        "bytes_per_second": F.when(dur > 0, bt / dur).otherwise(zero),
        "byte_ratio": F.when(F.col("byte_count_bwd") > 0, F.col("byte_count_fwd") / F.col("byte_count_bwd"))
                       .otherwise(zero),
        "down_up_ratio": F.when((F.col("byte_count_bwd") > 0) & (F.col("byte_count_fwd") > 0),
                                F.col("byte_count_bwd") / F.col("byte_count_fwd")).otherwise(zero),
        "packet_ratio": F.when(F.col("packet_count_bwd") > 0, F.col("packet_count_fwd") / F.col("packet_count_bwd"))
                         .otherwise(zero),
        "packet_length_mean": F.when(pt > 0, bt / pt).otherwise(zero),
    })


def keep_valid(flows: DataFrame) -> DataFrame:
    """Both IPs present and total bytes > 0."""
    return flows.where((F.col("src_ip") != "") & (F.col("dst_ip") != "") & (F.col("byte_count_total") > 0))


def add_defaults(df: DataFrame, defaults: dict = FIREWALL_DEFAULTS) -> DataFrame:
    """Add each missing column with its literal default."""
    return df.withColumns({k: F.lit(v) for k, v in defaults.items() if k not in df.columns})


def dedupe_sessions(flows: DataFrame, order_cols: list, require_key: bool = False) -> DataFrame:
    """Keep the first row per session_id (A3). With require_key=True rows
    without a session id are all kept instead of collapsing into one (Q13)."""
    if not require_key:
        return first_per_key(flows, ["session_id"], order_cols)
    has = F.col("session_id") != ""
    return first_per_key(flows.where(has), ["session_id"], order_cols).unionByName(flows.where(~has))


def firewall_flows(lines: DataFrame, *, line_col: str = "line", order_cols: list | None = None,
                   source_file=None, require_key: bool = False) -> DataFrame:
    """lines -> parse -> map -> keep valid -> dedupe on session -> defaults."""
    flows = keep_valid(to_flow(parse_lines(lines, line_col), source_file))
    flows = dedupe_sessions(flows, order_cols or [line_col], require_key)
    return add_defaults(flows)
