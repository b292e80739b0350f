"""Two-stage scoring and policy over flows.

Scores are columns: a model's probability enters either as an existing
column or through `apply_model`, a user-supplied pandas predictor run with
`mapInPandas` (Arrow batches). Everything after the probability is built-in
expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values (M2): policy thresholds (inclusive upper bounds) and reasons
POLICY = [
    (20, "ALLOW", "Low risk - legitimate traffic pattern detected"),
    (60, "CHALLENGE", "Medium risk - additional verification required (MFA/CAPTCHA)"),
    (None, "BLOCK", "High risk - suspicious activity detected"),
]
MALICIOUS_ABOVE = 60
ERROR_RESULT = (50, "UNKNOWN", 0.5)
# fixed values (C28, M4): application classes of the first stage, unknown last
APP_CLASSES = ["BROWSING", "CHAT", "VOIP", "VIDEO", "FILE_TRANSFER", "P2P", "C2_CNC", "UNKNOWN"]
# fixed values (C33): ordered feature names the served second stage expects
STAGE2_FEATURES = ["duration", "total_fiat", "total_biat", "min_fiat", "min_biat", "max_fiat", "max_biat",
                   "mean_fiat", "mean_biat", "flowPktsPerSecond", "flowBytesPerSecond", "min_flowiat",
                   "max_flowiat", "mean_flowiat", "std_flowiat", "min_active", "mean_active", "max_active",
                   "std_active", "min_idle", "mean_idle", "max_idle", "std_idle"]
# fixed values (C34): stage-1 flow-statistics vector
STAGE1_FEATURES = ["flow_duration", "total_fwd_packets", "total_bwd_packets", "total_length_fwd_packets",
                   "total_length_bwd_packets", "fwd_packet_length_mean", "bwd_packet_length_mean", "flow_iat_mean"]


# ------------------------------------------------------------------ M2
def policy(risk: Column) -> tuple[Column, Column]:
    """risk <= 20 ALLOW, <= 60 CHALLENGE, else BLOCK, with the reason text (M2)."""
    action = reason = None
    for bound, act, why in POLICY:
        cond = F.lit(True) if bound is None else (risk <= F.lit(bound))
        action = F.when(cond, F.lit(act)) if action is None else action.when(cond, F.lit(act))
        reason = F.when(cond, F.lit(why)) if reason is None else reason.when(cond, F.lit(why))
    return action, reason


# ------------------------------------------------------------------ M3
def risk_from_probability(p: Column, float32: bool = True) -> dict[str, Column]:
    """risk = int(p * 99); MALICIOUS iff risk > 60; confidence p or 1 - p;
    no/invalid probability -> (50, 'UNKNOWN', 0.5) (M3). With float32=True the
    probability is first rounded to float32, as a boosted-tree model emits."""
    pd_ = p.cast("float").cast("double") if float32 else p.cast("double")
    ok = pd_.isNotNull() & ~F.isnan(pd_)
    risk = F.when(ok, (pd_ * F.lit(99.0)).cast("bigint")).otherwise(F.lit(ERROR_RESULT[0]))
    intent = F.when(~ok, F.lit(ERROR_RESULT[1])) \
        .when(risk > MALICIOUS_ABOVE, F.lit("MALICIOUS")).otherwise(F.lit("BENIGN"))
    conf = F.when(~ok, F.lit(ERROR_RESULT[2])) \
        .when(risk > MALICIOUS_ABOVE, pd_).otherwise(F.lit(1.0) - pd_)
    return {"risk_score": risk, "intent_class": intent, "intent_confidence": conf}


# ------------------------------------------------------------------ M4 / C28
def app_class(probs: Column, classes: list[str] = APP_CLASSES) -> dict[str, Column]:
    """argmax class and its probability; index past the class list or no
    scores -> ('UNKNOWN', 0.0) (M4)."""
    mx = F.array_max(probs)
    idx = F.array_position(probs, mx)  # 1-based, first maximum
    names = F.array(*[F.lit(c) for c in classes])
    ok = probs.isNotNull() & (F.size(probs) > 0)
    cls = F.when(ok & (idx <= F.lit(len(classes))), F.element_at(names, idx.cast("int"))).otherwise(F.lit("UNKNOWN"))
    conf = F.when(ok, mx.cast("double")).otherwise(F.lit(0.0))
    return {"app_class": cls, "app_confidence": conf}


def encode_app_class(c: Column, classes: list[str] = APP_CLASSES) -> Column:
    """Class name -> index, unknown -> last index."""
    pos = F.array_position(F.array(*[F.lit(x) for x in classes]), c)
    return F.when(pos > 0, pos - 1).otherwise(F.lit(len(classes) - 1)).cast("int")


# ------------------------------------------------------------------ C33 / C34
def feature_vector(features: Column, names: list[str], *, protocol: Column | None = None,
                   is_vpn: Column | None = None, src_port: Column | None = None,
                   dst_port: Column | None = None) -> Column:
    """MAP<STRING,DOUBLE> -> ARRAY<FLOAT> in the given order (C33). Missing
    names fall back to request attributes (Protocol, vpn_flag, ports), else 0."""
    fb = {}
    if protocol is not None:
        fb["Protocol"] = F.when(F.upper(protocol) == "TCP", F.lit(6.0)).otherwise(F.lit(17.0))
    if is_vpn is not None:
        fb["vpn_flag"] = F.when(is_vpn, F.lit(1.0)).otherwise(F.lit(0.0))
    if src_port is not None:
        fb["src_port"] = src_port.cast("double")
    if dst_port is not None:
        fb["dst_port"] = dst_port.cast("double")
    items = [F.coalesce(F.try_element_at(features, F.lit(n)).cast("double"), fb.get(n, F.lit(0.0)), F.lit(0.0))
             for n in names]
    return F.array(*items).cast(T.ArrayType(T.FloatType()))


def stage1_vector(features: Column) -> Column:
    """Eight flow statistics for the first stage."""
    return feature_vector(features, STAGE1_FEATURES)


def features_map(df: DataFrame, mapping: dict[str, str]) -> Column:
    """Build the request feature map from flow columns: {name: column}."""
    return F.create_map(*[x for k, c in mapping.items() for x in (F.lit(k), F.col(c).cast("double"))])


# ------------------------------------------------------------------ model hook
def apply_model(df: DataFrame, vector_col: str, predict: Callable[[np.ndarray], np.ndarray],
                out_col: str = "p") -> DataFrame:
    """Run a user model on Arrow batches: `predict(matrix) -> probabilities`
    (the stage-2 model of the reference is a boosted-tree classifier). A row
    that the model fails on has a NULL probability, which M3 maps to its error
    result, and the reason in `<out_col>_error`; the other rows of its batch are
    scored (R9)."""
    fields = [T.StructField(out_col, T.DoubleType()), T.StructField(f"{out_col}_error", T.StringType())]

    def run(batches):
        for pdf in batches:
            scored = list(_predicted(list(pdf[vector_col]), predict))
            pdf[out_col] = pd.Series([p for p, _ in scored], dtype="float64", index=pdf.index)
            pdf[f"{out_col}_error"] = pd.Series([e for _, e in scored], dtype="object", index=pdf.index)
            yield pdf

    return df.mapInPandas(run, T.StructType(df.schema.fields + fields))


def _predicted(vectors: list, predict) -> Iterator[tuple[float | None, str | None]]:
    """(probability, error) of each row; a batch that fails is halved until the
    rows that it fails on are alone."""
    if not vectors:
        return
    try:
        out = np.asarray(predict(np.stack(vectors)), dtype="float64")
        if out.shape != (len(vectors),):
            raise ValueError(f"{out.shape} probabilities for {len(vectors)} rows")
        yield from ((float(p), None) for p in out)
    except Exception as e:  # noqa: BLE001 - whatever a user's model raises becomes the row's error
        if len(vectors) == 1:
            yield None, f"{type(e).__name__}: {e}"
        else:
            half = len(vectors) // 2
            yield from _predicted(vectors[:half], predict)
            yield from _predicted(vectors[half:], predict)


# ------------------------------------------------------------------ M5 / M6
def decide(df: DataFrame, p_col: str = "p", app_probs: str | None = None, float32: bool = True) -> DataFrame:
    """Two-stage result per row: stage-1 class (or ('UNKNOWN', 0.0) when no
    stage-1 scores are given, Q15) -> risk/intent -> action + reason (M5, M6)."""
    if app_probs is not None:
        a = app_class(F.col(app_probs))
    else:
        a = {"app_class": F.lit("UNKNOWN"), "app_confidence": F.lit(0.0)}
    d = df.withColumns(a).withColumns(risk_from_probability(F.col(p_col), float32))
    action, reason = policy(F.col("risk_score"))
    return d.withColumns({"action": action, "reason": reason})


# ------------------------------------------------------------------ M9
def edge_prefilter(df: DataFrame, *, fraud_col: str = "fraud_score", datacenter_col: str = "is_datacenter",
                   bad_asn_col: str = "bad_asn", mtu_col: str = "mtu", fraud_block: int = 90,
                   vpn_mtu_below: int = 1350) -> DataFrame:
    """Documented edge rules (M9): fraud > 90 -> BLOCK; datacenter and bad
    ASN -> BLOCK; MTU < 1350 -> VPN flag, passed on."""
    block = (F.col(fraud_col) > fraud_block) | (F.col(datacenter_col) & F.col(bad_asn_col))
    return df.withColumns({
        "edge_action": F.when(block, F.lit("BLOCK")).otherwise(F.lit("PASS")),
        "edge_vpn_flag": ((F.col(mtu_col) >= 0) & (F.col(mtu_col) < vpn_mtu_below)).cast("int"),
    })
