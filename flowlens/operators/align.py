"""Schema alignment of flow tables to the 49-column core (P3-P10), merge of
aligned sources (U1) and label normalisation (J6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the core columns, in order
CORE = [
    "src_ip", "dst_ip", "src_port", "dst_port", "protocol",
    "timestamp", "flow_duration",
    "packet_count_fwd", "packet_count_bwd", "packet_count_total",
    "byte_count_fwd", "byte_count_bwd", "byte_count_total",
    "packet_length_min", "packet_length_max", "packet_length_mean", "packet_length_std", "packet_length_variance",
    "mean_iat_fwd", "mean_iat_bwd", "mean_iat_total", "std_iat_fwd", "std_iat_bwd", "std_iat_total",
    "min_iat_total", "max_iat_total",
    "packets_per_second", "bytes_per_second",
    "byte_ratio", "packet_ratio", "down_up_ratio",
    "syn_flag_count", "ack_flag_count", "fin_flag_count", "rst_flag_count", "psh_flag_count",
    "active_mean", "active_std", "idle_mean", "idle_std",
    "ttl", "window_size", "mtu", "mss",
    "app_label", "intent_label", "vpn_flag",
    "dataset_source", "source_file",
]
# fixed values (P9): column types after alignment
INT_COLUMNS = ["src_port", "dst_port", "protocol", "packet_count_fwd", "packet_count_bwd", "packet_count_total",
               "byte_count_fwd", "byte_count_bwd", "byte_count_total", "syn_flag_count", "ack_flag_count",
               "fin_flag_count", "rst_flag_count", "psh_flag_count", "ttl", "window_size", "mtu", "mss", "vpn_flag"]
FLOAT_COLUMNS = ["flow_duration", "packet_length_min", "packet_length_max", "packet_length_mean",
                 "packet_length_std", "packet_length_variance", "mean_iat_fwd", "mean_iat_bwd", "mean_iat_total",
                 "std_iat_fwd", "std_iat_bwd", "std_iat_total", "min_iat_total", "max_iat_total",
                 "packets_per_second", "bytes_per_second", "byte_ratio", "packet_ratio", "down_up_ratio",
                 "active_mean", "active_std", "idle_mean", "idle_std"]
STRING_COLUMNS = ["src_ip", "dst_ip", "app_label", "intent_label", "dataset_source", "source_file"]
UNKNOWN_SENTINEL_COLUMNS = ["ttl", "window_size", "mtu", "mss", "vpn_flag", "encryption_detected"]

# fixed values (P3): CIC flow-export column names (compared after trimming the
# leading space some exports carry) -> aligned names
CIC_COLUMNS = {
    "Source IP": "src_ip", "Destination IP": "dst_ip", "Source Port": "src_port",
    "Destination Port": "dst_port", "Protocol": "protocol",
    "Timestamp": "timestamp", "Flow Duration": "flow_duration",
    "Total Fwd Packets": "packet_count_fwd", "Total Backward Packets": "packet_count_bwd",
    "Fwd Packets Length Total": "byte_count_fwd", "Bwd Packets Length Total": "byte_count_bwd",
    "Total Length of Fwd Packets": "byte_count_fwd", "Total Length of Bwd Packets": "byte_count_bwd",
    "Fwd Packet Length Max": "packet_length_max_fwd", "Fwd Packet Length Min": "packet_length_min_fwd",
    "Fwd Packet Length Mean": "packet_length_mean_fwd", "Fwd Packet Length Std": "packet_length_std_fwd",
    "Bwd Packet Length Max": "packet_length_max_bwd", "Bwd Packet Length Min": "packet_length_min_bwd",
    "Bwd Packet Length Mean": "packet_length_mean_bwd", "Bwd Packet Length Std": "packet_length_std_bwd",
    "Flow Packets/s": "packets_per_second", "Flow Bytes/s": "bytes_per_second",
    "Flow IAT Mean": "mean_iat_total", "Flow IAT Std": "std_iat_total",
    "Flow IAT Max": "max_iat_total", "Flow IAT Min": "min_iat_total",
    "Fwd IAT Mean": "mean_iat_fwd", "Fwd IAT Std": "std_iat_fwd", "Fwd IAT Max": "max_iat_fwd",
    "Fwd IAT Min": "min_iat_fwd",
    "Bwd IAT Mean": "mean_iat_bwd", "Bwd IAT Std": "std_iat_bwd", "Bwd IAT Max": "max_iat_bwd",
    "Bwd IAT Min": "min_iat_bwd",
    "FIN Flag Count": "fin_flag_count", "SYN Flag Count": "syn_flag_count", "RST Flag Count": "rst_flag_count",
    "PSH Flag Count": "psh_flag_count", "ACK Flag Count": "ack_flag_count", "URG Flag Count": "urg_flag_count",
    "Active Mean": "active_mean", "Active Std": "active_std", "Active Max": "active_max", "Active Min": "active_min",
    "Idle Mean": "idle_mean", "Idle Std": "idle_std", "Idle Max": "idle_max", "Idle Min": "idle_min",
    "Down/Up Ratio": "down_up_ratio",
    "intent_label": "intent_label", "app_label": "app_label", "vpn_flag": "vpn_flag",
    "dataset_source": "dataset_source",
}
# fixed values (P4): the smaller map used when labelled flow files are ingested
# (note: forward mean/std become the overall mean/std)
CIC_INGEST_COLUMNS = {
    "Source IP": "src_ip", "Destination IP": "dst_ip", "Source Port": "src_port", "Destination Port": "dst_port",
    "Protocol": "protocol", "Flow Duration": "flow_duration", "Total Fwd Packets": "packet_count_fwd",
    "Total Backward Packets": "packet_count_bwd", "Total Length of Fwd Packets": "byte_count_fwd",
    "Total Length of Bwd Packets": "byte_count_bwd", "Fwd Packet Length Mean": "packet_length_mean",
    "Fwd Packet Length Std": "packet_length_std", "Flow Packets/s": "packets_per_second",
    "Flow Bytes/s": "bytes_per_second", "Flow IAT Mean": "mean_iat_total", "Flow IAT Std": "std_iat_total",
    "Fwd IAT Mean": "mean_iat_fwd", "Bwd IAT Mean": "mean_iat_bwd",
}
# fixed values (J6): intent label normalisation, unknown names kept as they are
INTENT_LABELS = {
    "DoS Wednesday": "DoS", "DDoS Friday": "DDoS", "Benign Monday": "Benign", "Botnet Friday": "Botnet",
    "Infiltration Thursday": "Infiltration", "WebAttacks Thursday": "Web_Attack", "Portscan Friday": "Portscan",
    "Benign": "Benign", "DoS": "DoS", "DDoS": "DDoS", "Botnet": "Botnet", "BruteForce": "BruteForce",
    "Portscan": "Portscan", "Infiltration": "Infiltration", "Web_Attack": "Web_Attack",
    "Suspicious": "Suspicious", "Malicious": "Malicious", "Unknown": "Unknown",
}
# fixed values (J6): attack names of labelled flow files -> intent classes
CIC_ATTACK_LABELS = {
    "BENIGN": "Benign", "Benign": "Benign", "Bot": "Botnet", "DDoS": "DDoS", "DoS Hulk": "DoS",
    "DoS GoldenEye": "DoS", "DoS slowloris": "DoS", "DoS Slowhttptest": "DoS", "FTP-Patator": "BruteForce",
    "SSH-Patator": "BruteForce", "PortScan": "Portscan", "Infiltration": "Infiltration",
    "Web Attack – Brute Force": "Web_Attack", "Web Attack – XSS": "Web_Attack",
    "Web Attack – Sql Injection": "Web_Attack", "Heartbleed": "Web_Attack",
}


def map_or_keep(c: Column, mapping: dict) -> Column:
    """Dictionary lookup; names not in the dictionary pass through."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(m, c), c)


def rename_columns(df: DataFrame, mapping: dict) -> DataFrame:
    """Rename by a {source name: target} map, comparing trimmed names.
    When several sources land on one target the first non-NULL wins
    (`coalesce`), where pandas would produce duplicate columns."""
    targets: dict[str, list[str]] = {}
    for c in df.columns:
        t = mapping.get(c.strip())
        if t is not None:
            targets.setdefault(t, []).append(c)
    if not targets:
        return df
    renamed = set(c for cs in targets.values() for c in cs)
    keep = [F.col(f"`{c}`") for c in df.columns if c not in renamed and c not in targets]
    new = [F.coalesce(*[F.col(f"`{c}`") for c in cs]).alias(t) if len(cs) > 1 else F.col(f"`{cs[0]}`").alias(t)
           for t, cs in targets.items()]
    return df.select(*keep, *new)


def derive_missing(df: DataFrame) -> DataFrame:
    """Derive totals, overall length stats and ratios when absent."""
    cols = set(df.columns)
    out = {}

    def has(*names):
        return all(n in cols or n in out for n in names)

    def c(n):
        return out.get(n, F.col(n))
    if "packet_count_total" not in cols and has("packet_count_fwd", "packet_count_bwd"):
        out["packet_count_total"] = c("packet_count_fwd") + c("packet_count_bwd")
    if "byte_count_total" not in cols and has("byte_count_fwd", "byte_count_bwd"):
        out["byte_count_total"] = c("byte_count_fwd") + c("byte_count_bwd")
    if "packet_length_min" not in cols and has("packet_length_min_fwd", "packet_length_min_bwd"):
        out["packet_length_min"] = F.least(c("packet_length_min_fwd"), c("packet_length_min_bwd"))
    if "packet_length_max" not in cols and has("packet_length_max_fwd", "packet_length_max_bwd"):
        out["packet_length_max"] = F.greatest(c("packet_length_max_fwd"), c("packet_length_max_bwd"))
    if "packet_length_mean" not in cols and has("packet_length_mean_fwd", "packet_length_mean_bwd",
                                                 "packet_count_fwd", "packet_count_bwd"):
        tot = c("packet_count_fwd") + c("packet_count_bwd")
        out["packet_length_mean"] = (c("packet_length_mean_fwd") * c("packet_count_fwd")
                                     + c("packet_length_mean_bwd") * c("packet_count_bwd")) \
            / F.when(tot == 0, F.lit(1)).otherwise(tot)
    if "packet_length_std" not in cols and has("packet_length_std_fwd", "packet_length_std_bwd"):
        out["packet_length_std"] = (c("packet_length_std_fwd") + c("packet_length_std_bwd")) / 2
    if "packet_length_variance" not in cols and has("packet_length_std"):
        out["packet_length_variance"] = c("packet_length_std") * c("packet_length_std")
    for name, num, den in (("byte_ratio", "byte_count_fwd", "byte_count_bwd"),
                           ("packet_ratio", "packet_count_fwd", "packet_count_bwd")):
        if name not in cols and has(num, den):  # Q1: divide by 1 on a zero denominator
            out[name] = c(num) / F.when(c(den) == 0, F.lit(1)).otherwise(c(den))
    return df.withColumns(out) if out else df


def default_for(name: str, require_key: bool = False, dataset_source: str = "Unknown") -> Column:
    """Typed default of a missing core column."""
    if name.endswith(("_count", "_total")):
        return F.lit(0).cast("bigint")
    if name in UNKNOWN_SENTINEL_COLUMNS:
        return F.lit(-1).cast("bigint")
    if name == "timestamp":
        return F.lit(None).cast("timestamp")
    if name in ("app_label", "intent_label", "source_file", "protocol_hint"):
        return F.lit("Unknown")
    if name == "dataset_source":
        return F.lit(dataset_source)
    if require_key and name in ("src_ip", "dst_ip"):
        return F.lit("Unknown")
    return F.lit(0.0)


def add_missing_core(df: DataFrame, require_key: bool = False, dataset_source: str = "Unknown") -> DataFrame:
    """Add every absent core column with its default (P7). With
    require_key=True absent IPs become 'Unknown' rather than 0.0, so
    key-less rows can be kept apart from real keys in dedupe (Q6)."""
    return df.withColumns({c: default_for(c, require_key, dataset_source) for c in CORE if c not in df.columns})


def coerce_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """19 ints (bad -> 0), 23 floats (bad -> 0.0), 6 strings (NULL/'nan' ->
    'Unknown'), timestamp (bad -> NULL) (P9); of `columns` only, where given."""
    out = {}
    types = dict(df.dtypes)
    integral = ("bigint", "int", "smallint", "tinyint")

    def as_double(c):
        # numeric columns are widened directly; only text goes through parsing
        t = types[c]
        if t in integral or t in ("double", "float") or t.startswith("decimal"):
            return F.col(c).cast("double")
        return F.col(c).cast("string").try_cast("double")
    for c in INT_COLUMNS:
        if c in df.columns:
            if types[c] in integral:
                out[c] = F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint"))
            else:
                d = as_double(c)
                out[c] = F.coalesce(F.when(~F.isnan(d), d).try_cast("bigint"), F.lit(0)).cast("bigint")
    for c in FLOAT_COLUMNS:
        if c in df.columns:
            d = as_double(c)
            out[c] = F.coalesce(F.when(~F.isnan(d), d), F.lit(0.0))
    for c in STRING_COLUMNS:
        if c in df.columns:
            s = F.col(c).cast("string")
            out[c] = F.when(s.isNull() | (s == "nan"), F.lit("Unknown")).otherwise(s)
    if "timestamp" in df.columns and dict(df.dtypes)["timestamp"] != "timestamp":
        out["timestamp"] = F.col("timestamp").cast("string").try_cast("timestamp")
    return df.withColumns({c: e for c, e in out.items() if columns is None or c in columns})


def reorder(df: DataFrame) -> DataFrame:
    """Core columns in order, then the rest in input order (P10)."""
    return df.select(*[c for c in CORE if c in df.columns], *[c for c in df.columns if c not in CORE])


def align(df: DataFrame, *, mapping: dict | None = None, require_key: bool = False,
          dataset_source: str = "Unknown") -> DataFrame:
    """rename -> derive -> add missing -> coerce -> reorder."""
    if mapping:
        df = rename_columns(df, mapping)
    return reorder(coerce_types(add_missing_core(derive_missing(df), require_key, dataset_source)))


def merge(frames: list[DataFrame], normalize_intent: bool = True) -> DataFrame:
    """By-name union of aligned sources, absent columns NULL (U1); then intent
    labels normalised (J6). Any subset of sources may be missing; none is an
    error (S10)."""
    frames = [f for f in frames if f is not None]
    if not frames:
        raise ValueError("no aligned dataset to merge")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    if normalize_intent and "intent_label" in out.columns:
        out = out.withColumn("intent_label", map_or_keep(F.col("intent_label"), INTENT_LABELS))
    return out
