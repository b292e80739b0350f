"""Dataset cleaning: flow dedupe, missing values, quality checks (A2, A4,
P15-P18, P23, P24)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.exprs import zero_if_not_finite
from flowlens.operators.topk import first_per_key

FIVE_TUPLE = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol"]
UNKNOWN_KEY_VALUES = ["", "Unknown", "0", "0.0"]


def dedupe_flows(df: DataFrame, order_cols: list, *, key_cols: list[str] | None = None,
                 scope: str = "global", require_key: bool = False,
                 source_col: str = "dataset_source") -> DataFrame:
    """Keep-first on the flow 5-tuple; the full row when a key column is
    absent (A2). scope='per_source' adds the source to the key; with
    require_key=True rows whose IPs are unknown are all kept (Q6)."""
    key = list(key_cols or FIVE_TUPLE)
    if not all(k in df.columns for k in key):
        return first_per_key(df, [c for c in df.columns if c not in order_cols], order_cols) \
            if order_cols else df.dropDuplicates()
    if scope == "per_source":
        key = key + [source_col]
    if not require_key:
        return first_per_key(df, key, order_cols)
    known = F.lit(True)
    for c in ("src_ip", "dst_ip"):
        if c in key:
            known = known & F.col(c).isNotNull() & ~F.col(c).cast("string").isin(UNKNOWN_KEY_VALUES)
    return first_per_key(df.where(known), key, order_cols).unionByName(df.where(~known))


def dedupe_flows_per_second(df: DataFrame, order_cols: list) -> DataFrame:
    """Keep-first on 5-tuple + timestamp floored to the second (A4)."""
    d = df.withColumn("_sec", F.date_trunc("second", F.col("timestamp")))
    return first_per_key(d, FIVE_TUPLE + ["_sec"], order_cols).drop("_sec")


def similarity_cell(value, similarity: float = 0.95):
    """Cell of a non-negative measure on a logarithmic grid: two values in one
    cell have (1 + smaller) / (1 + larger) > `similarity`. NULL has its own."""
    return F.floor(F.log(F.lit(1.0) + F.greatest(F.col(value).cast("double"), F.lit(0.0))) / F.lit(-math.log(similarity)))


def drop_near_duplicates(df: DataFrame, features: list[str], order_cols: list, *, key_cols: list[str] | None = None,
                         similarity: float = 0.95) -> DataFrame:
    """Flows of one cell (D11, coarse): rows with the same key whose features all
    lie in the same cells count as one flow, the first under `order_cols` stays.
    The cells are equality keys, so no pair of rows is ever compared, and alike
    flows on both sides of a border both stay; `drop_similar` finds those too."""
    cells = {f"_cell_{c}": similarity_cell(c, similarity) for c in features}
    keys = [*(key_cols or ["src_ip", "dst_ip", "dst_port", "protocol"]), *cells]
    return first_per_key(df.withColumns(cells), keys, order_cols).drop(*cells)


def _measure(column):
    """A non-negative measure; not a number counts as missing."""
    x = column.cast("double")
    return F.when(x.isNull() | F.isnan(x), F.lit(None)).otherwise(F.greatest(x, F.lit(0.0)))


def drop_similar(df: DataFrame, features: list[str], order_cols: list[str], *, key_cols: list[str] | None = None,
                 similarity: float = 0.95) -> DataFrame:
    """Near-duplicate flows by definition (D11): a row goes where an earlier row
    of the same key (kept or not, under the ascending `order_cols`) resembles it,
    which means min / max >= `similarity` in every feature; zeros resemble zeros
    and NULLs resemble NULLs only.

    Cells of a logarithmic grid are buckets. Rows of one cell resemble each
    other, so only its first row can stay, and that one is held against the
    earlier rows of the adjacent cells: a row meets a few others, however dense
    its cell is."""
    if not 0 < similarity < 1:
        raise ValueError("similarity must lie between 0 and 1")
    keys = list(key_cols or ["src_ip", "dst_ip", "dst_port", "protocol"])
    width, reach = -math.log(similarity) * (1 - 1e-9), -math.log(similarity) * (1 + 1e-9)  # safe from rounding

    def cell(column, shift=0.0):
        x = _measure(column)
        return F.when(x.isNull(), F.lit(-1 << 41)).when(x == 0, F.lit(-1 << 40)) \
            .otherwise(F.floor((F.log(x) + F.lit(shift)) / F.lit(width)))

    cells = [f"_cell_{i}" for i in range(len(features))]
    placed = df.withColumns({c: cell(F.col(f)) for c, f in zip(cells, features)})
    first = first_per_key(placed, keys + cells, order_cols)
    rows = placed.groupBy(*keys, *cells, *features).agg(F.min(F.struct(*order_cols)).alias("_at"))
    looks = first.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)),
                         *(F.col(c).alias(f"_own{i}") for i, c in enumerate(cells)),
                         *(F.col(f).alias(f"_f{i}") for i, f in enumerate(features)),
                         F.struct(*order_cols).alias("_own_at"))
    for i in range(len(features)):
        f = F.col(f"_f{i}")
        looks = looks.withColumn(f"_look{i}", F.explode(F.sequence(cell(f, -reach), cell(f, reach))))
    met = F.col("_at") < F.col("_own_at")
    for i, k in enumerate(keys):
        met &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    for i, (c, f) in enumerate(zip(cells, features)):
        a, b = _measure(F.col(f)), _measure(F.col(f"_f{i}"))
        met &= (F.col(c) == F.col(f"_look{i}")) & ((a.isNull() & b.isNull()) | (F.least(a, b) >= F.lit(similarity) * F.greatest(a, b)))
    gone = rows.join(looks, met).select([f"_k{i}" for i in range(len(keys))] + [f"_own{i}" for i in range(len(cells))]).distinct()
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    for i, c in enumerate(cells):
        same &= F.col(c) == F.col(f"_own{i}")
    return first.join(gone, same, "left_anti").drop(*cells)


def null_count_expr(columns: list[str]):
    return sum((F.col(f"`{c}`").isNull().cast("int") for c in columns), F.lit(0))


def drop_sparse_rows(df: DataFrame, threshold: float = 0.5, columns: list[str] | None = None) -> DataFrame:
    """Drop rows whose NULL share over `columns` (default all) exceeds the
    threshold; exactly half is kept (P15). Row-local: no shuffle."""
    cols = list(columns or df.columns)
    return df.where(null_count_expr(cols) / F.lit(float(len(cols))) <= F.lit(threshold))


def fill_missing(df: DataFrame) -> DataFrame:
    """NULL numerics -> 0, NULL strings -> 'Unknown' (P16)."""
    num, txt = {}, {}
    for c, t in df.dtypes:
        if t in ("string",):
            txt[c] = "Unknown"
        elif t in ("int", "bigint", "double", "float", "smallint", "tinyint") or t.startswith("decimal"):
            num[c] = 0
    return df.fillna(num).fillna(txt)


# fixed values (P17): columns whose unknown value is -1 instead of 0
SENTINEL_FILL = ["ttl", "window_size", "mtu", "mss", "vpn_flag", "encryption_detected",
                 "syn_flag_count", "ack_flag_count", "fin_flag_count", "rst_flag_count", "psh_flag_count"]


def fill_missing_sentinel(df: DataFrame) -> DataFrame:
    """Documented variant: infrastructure and flag columns -1, other numerics 0."""
    num = {c: (-1 if c in SENTINEL_FILL else 0) for c, t in df.dtypes
           if t in ("int", "bigint", "double", "float") or t.startswith("decimal")}
    return df.fillna(num)


def finite_or_zero(df: DataFrame, columns: list[str]) -> DataFrame:
    """+-inf and NaN -> 0 before training."""
    return df.withColumns({c: zero_if_not_finite(F.col(c)) for c in columns})


def quality_report(df: DataFrame) -> DataFrame:
    """One-row quality check in a single pass (P23, P24): NULLs in critical
    columns, invalid ports, protocols outside {1, 6, 17}, invalid IPv4 text,
    non-positive durations."""
    ip_re = r"^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$"
    aggs = [F.count(F.lit(1)).alias("rows")]
    for c in ("src_ip", "dst_ip", "protocol", "intent_label"):
        aggs.append(F.count_if(F.col(c).isNull()).alias(f"null_{c}"))
    aggs += [
        F.count_if((F.col("src_port") < 0) | (F.col("src_port") > 65535)
                   | (F.col("dst_port") < 0) | (F.col("dst_port") > 65535)).alias("invalid_ports"),
        F.count_if(F.col("protocol").isin(1, 6, 17)).alias("valid_protocols"),
        F.count_if(~F.col("src_ip").rlike(ip_re) | ~F.col("dst_ip").rlike(ip_re)).alias("invalid_ips"),
        F.count_if(F.col("flow_duration") <= 0).alias("non_positive_duration"),
        F.count_if(F.col("app_label") != "Unknown").alias("known_app_label"),
    ]
    return df.agg(*aggs)
