"""Packet-level attributes joined onto flows: first SYN (F12, J1) and payload
entropy (F13, J2)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.operators.topk import top_n_per_group
from flowlens.sources.tables import spread

DIRECTED = ["src_ip", "src_port", "dst_ip", "dst_port"]
DEFAULT_MSS = 1460
MTU_OVERHEAD = 40
ENCRYPTION_ENTROPY = 7.5


# ------------------------------------------------------------------ F12
def first_syn(packets: DataFrame, *, keep: str = "first", syn_filter: str = "syn_only",
              default_mss: int = DEFAULT_MSS) -> DataFrame:
    """One SYN record per directed 4-tuple.

    syn_filter='syn_only' keeps SYN without ACK (full pipeline); 'syn' any SYN.
    keep='first' / 'last' picks by (ts_us, packet_no). `min_by` / `max_by` are
    plain aggregates: partial aggregation runs before the shuffle, so a key
    with millions of SYNs (a SYN flood) never gathers in one task.
    """
    flags = F.col("flags")
    is_syn = (F.col("protocol") == 6) & (flags.bitwiseAND(F.lit(2)) != 0)
    if syn_filter == "syn_only":
        is_syn = is_syn & (flags.bitwiseAND(F.lit(16)) == 0)
    rec = F.struct(
        F.coalesce(F.col("mss"), F.lit(default_mss)).cast("bigint").alias("tcp_mss"),
        F.col("ttl").cast("bigint").alias("ip_ttl"),
        F.col("win").cast("bigint").alias("tcp_window"),
        F.col("opts").cast("bigint").alias("tcp_options_count"),
    )
    order = F.struct("ts_us", "packet_no")
    pick = F.min_by if keep == "first" else F.max_by
    out = (packets.where(is_syn).groupBy(*DIRECTED)
           .agg(pick(rec, order).alias("r")))
    return out.select(*DIRECTED, "r.*", (F.col("r.tcp_mss") + MTU_OVERHEAD).alias("tcp_mtu"))


# ------------------------------------------------------------------ J1
def join_handshake(flows: DataFrame, syn: DataFrame) -> DataFrame:
    """flows LEFT JOIN first-SYN on the directed 4-tuple; protocol is not part
    of the key (J1). Misses stay NULL, as in the reference's merge, but when
    there is no SYN at all the five columns are 0."""
    none = syn.agg(F.count(F.lit(1)) == 0).scalar()
    added = [c for c in syn.columns if c not in DIRECTED]
    joined = flows.join(syn, on=DIRECTED, how="left")
    return joined.withColumns({c: F.when(none, F.lit(0)).otherwise(F.col(c)).cast("bigint") for c in added})


# ------------------------------------------------------------------ F13
def _entropy_np(values: pd.Series) -> pd.Series:
    out = np.zeros(len(values), dtype=np.float64)
    for i, b in enumerate(values):
        if b is None or len(b) == 0:
            continue
        counts = np.bincount(np.frombuffer(bytes(b), dtype=np.uint8), minlength=256)
        p = counts[counts > 0] / float(len(b))
        out[i] = float(-(p * np.log2(p)).sum())
    return pd.Series(out)


@F.pandas_udf(T.DoubleType())
def byte_entropy(payload: pd.Series) -> pd.Series:
    """Shannon entropy (base 2) of a byte string; 0 for empty.

    Arrow-batched; the byte histogram is one numpy bincount per payload.
    The all-native alternative explodes every payload byte into a row and
    shuffles them, which costs far more than this per-value helper.
    """
    return _entropy_np(payload)


def payload_entropy(payloads: DataFrame, *, sample_size: int | None = None,
                    partition_col: str | None = None) -> DataFrame:
    """Mean payload entropy per directed endpoint pair (F13). Empty payloads
    are skipped. `sample_size` reproduces the reference's first-N-packets
    sampling per capture (`partition_col`); None uses every packet."""
    p = spread(payloads.where(F.length("payload") > 0))
    if sample_size is not None:
        p = top_n_per_group(p, [partition_col] if partition_col else [], ["packet_no"], sample_size)
    return (p.withColumn("_h", byte_entropy("payload"))
             .groupBy(*DIRECTED).agg(F.avg("_h").alias("entropy_score"),
                                     F.count(F.lit(1)).alias("payload_packets")))


# ------------------------------------------------------------------ J2
def join_entropy(flows: DataFrame, entropy: DataFrame) -> DataFrame:
    """flows LEFT JOIN mean entropy on the directed endpoints (4 columns, not
    a formatted string); miss -> 0.0; encryption_detected = entropy > 7.5 (J2)."""
    j = flows.join(entropy.select(*DIRECTED, F.col("entropy_score").alias("_ent")), on=DIRECTED, how="left")
    ent = F.coalesce(F.col("_ent"), F.lit(0.0))
    return j.drop("entropy_score", "encryption_detected").withColumns(
        {"entropy_score": ent, "encryption_detected": (ent > ENCRYPTION_ENTROPY).cast("int")}).drop("_ent")
