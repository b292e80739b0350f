"""Dataset profile.

Every statistic is a distributed aggregate; only the small result tables
(one row per column, label or bin) are ever materialised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.topk import top_k_counts

NUMERIC = ("int", "bigint", "smallint", "tinyint", "double", "float")


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in NUMERIC or t.startswith("decimal")]


def distribution(df: DataFrame, col: str) -> DataFrame:
    """Counts and percentage per value (A6, A12). The percentage uses a
    window over the (small) aggregated table, not over the input."""
    g = df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    return g.withColumn("pct", F.col("count") * F.lit(100.0) / F.sum("count").over(Window.partitionBy()))


def null_counts(df: DataFrame) -> DataFrame:
    """(column, nulls, dtype) for every column from one aggregate pass."""
    cols = df.columns
    agg = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(cols)])
    types = dict(df.dtypes)
    stack = ", ".join(f"'{c}', n{i}, '{types[c]}'" for i, c in enumerate(cols))
    return agg.selectExpr(f"stack({len(cols)}, {stack}) AS (column, nulls, dtype)")


def basic_stats(df: DataFrame) -> DataFrame:
    """rows, columns, missing cells, duplicate rows (rows - distinct rows),
    per-type column counts as a map (A9)."""
    cols = df.columns
    missing = sum((F.col(f"`{c}`").isNull().cast("bigint") for c in cols), F.lit(0).cast("bigint"))
    base = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(missing).alias("missing_values"))
    distinct_rows = df.distinct().count()
    type_counts: dict[str, int] = {}
    for _, t in df.dtypes:
        type_counts[t] = type_counts.get(t, 0) + 1
    tmap = F.create_map(*[F.lit(x) for kv in sorted(type_counts.items()) for x in kv])
    return base.select(
        "rows", F.lit(len(cols)).alias("columns"), F.coalesce("missing_values", F.lit(0)).alias("missing_values"),
        (F.col("rows") - F.lit(distinct_rows)).alias("duplicate_rows"), tmap.alias("data_types"))


def correlations(df: DataFrame, max_columns: int | None = None) -> DataFrame:
    """Pearson correlation of the numeric columns (the first `max_columns` of
    them if asked for), long form (col_a, col_b, corr), all pairs in a single aggregate pass (A10)."""
    cols = numeric_columns(df)[:max_columns]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, corr double")
    agg = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}")
                   for i, (a, b) in enumerate(pairs)])
    stack = ", ".join(f"'{a}', '{b}', c{i}" for i, (a, b) in enumerate(pairs))
    return agg.selectExpr(f"stack({len(pairs)}, {stack}) AS (col_a, col_b, corr)")


# fixed values (A11): the six flow histograms and their transforms
FLOW_HISTOGRAMS = [
    ("packet_count_total", "clip", 1000.0),
    ("byte_count_total", "log10p1", None),
    ("flow_duration", "clip", 300.0),
    ("packet_length_mean", "clip", 2000.0),
    ("mean_iat_total", "log10p1", None),
    ("byte_ratio", "clip", 10.0),
]


def histogram(df: DataFrame, col: str, transform: str | None = None, arg: float | None = None,
              bins: int = 50) -> DataFrame:
    """Equal-width histogram between the data's min and max, last bin closed;
    a constant column spans value +- 0.5 (A11). Two passes: min/max, counts."""
    x = F.col(col).cast("double")
    if transform == "clip":
        x = F.least(x, F.lit(arg))
    elif transform == "log10p1":
        x = F.log10(x + F.lit(1.0))
    v = df.select(x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    mm = v.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    if mm["lo"] is None:
        return df.sparkSession.createDataFrame([], "column string, bin int, lo double, hi double, count long")
    lo, hi = float(mm["lo"]), float(mm["hi"])
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    idx = F.least(F.floor((F.col("x") - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(bins))), F.lit(bins - 1))
    counts = v.groupBy(idx.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    width = (hi - lo) / bins
    return counts.select(F.lit(col).alias("column"), "bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lo"),
                         (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("hi"), "count")


def _transformed(col: str, transform: str | None, arg: float | None) -> Column:
    x = F.col(col).cast("double")
    if transform == "clip":
        x = F.least(x, F.lit(arg))
    elif transform == "log10p1":
        x = F.log10(x + F.lit(1.0))
    return F.when(~F.isnan(x), x)


def binned(df: DataFrame, columns: dict[str, Column], keep: list[str], bounds_to_bin) -> DataFrame:
    """(column, bin, lo, hi, keep...) for each row and column with a value: the
    bounds of all columns come from one aggregate, a scalar subquery of the same
    plan, and rows are unpivoted once; bounds_to_bin(x, lo, hi) gives the bin."""
    names = list(columns)
    v = df.select(*keep, *[columns[c].alias(f"_x{i}") for i, c in enumerate(names)])
    ends = v.agg(F.struct(*[f(f"_x{i}").alias(f"{n}{i}") for i in range(len(names))
                            for n, f in (("lo", F.min), ("hi", F.max))])).scalar()
    d = v.withColumn("_ends", ends)

    def entry(i: int, c: str) -> Column:
        x, lo, hi = F.col(f"_x{i}"), F.col(f"_ends.lo{i}"), F.col(f"_ends.hi{i}")
        at = F.when(x.isNotNull(), bounds_to_bin(x, lo, hi)).cast("int")
        return F.struct(F.lit(c).alias("column"), at.alias("bin"), lo.alias("lo"), hi.alias("hi"))

    entries = [entry(i, c) for i, c in enumerate(names)]
    return d.select(*keep, F.explode(F.array(*entries)).alias("_e")).select("_e.*", *keep).where("bin is not null")


def histograms(df: DataFrame, specs: list[tuple], bins: int = 50) -> DataFrame:
    """`histogram` of several columns (column, transform, argument) in two scans
    and one small shuffle, whatever their number (A11)."""
    def bin_of(x: Column, lo: Column, hi: Column) -> Column:
        same = lo == hi
        low = F.when(same, lo - 0.5).otherwise(lo)
        width = F.when(same, F.lit(1.0)).otherwise(hi - lo)
        return F.least(F.floor((x - low) / width * F.lit(float(bins))), F.lit(bins - 1))

    counts = binned(df, {c: _transformed(c, t, a) for c, t, a in specs}, [], bin_of) \
        .groupBy("column", "bin", "lo", "hi").agg(F.count(F.lit(1)).alias("count"))
    low = F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo"))
    width = F.when(F.col("lo") == F.col("hi"), F.lit(1.0)).otherwise(F.col("hi") - F.col("lo")) / F.lit(float(bins))
    return counts.select("column", "bin", (low + F.col("bin") * width).alias("lo"),
                         (low + (F.col("bin") + 1) * width).alias("hi"), "count")


def traffic_summary(df: DataFrame, vpn_ports: list[int]) -> DataFrame:
    """Totals, means, encrypted share and VPN-port share."""
    enc = F.col("encryption_detected") if "encryption_detected" in df.columns else F.lit(0)
    return df.agg(
        F.count(F.lit(1)).alias("flows"),
        F.sum("packet_count_total").alias("total_packets"), F.sum("byte_count_total").alias("total_bytes"),
        F.avg("flow_duration").alias("mean_duration"), F.avg("packet_count_total").alias("mean_packets"),
        (F.avg((enc == 1).cast("double")) * 100.0).alias("encrypted_pct"),
        (F.avg(F.col("dst_port").isin(vpn_ports).cast("double")) * 100.0).alias("vpn_port_pct"),
    )


def per_source_totals(df: DataFrame, source_col: str = "source_file") -> DataFrame:
    """Per-file packet and byte sums."""
    return df.groupBy(source_col).agg(F.count(F.lit(1)).alias("flows"),
                                      F.sum("packet_count_total").alias("packets"),
                                      F.sum("byte_count_total").alias("bytes"))


def imbalance(df: DataFrame, label_col: str, warn_above: float = 5.0) -> DataFrame:
    """max/min class count and a warning flag (A15); distinct labels."""
    d = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    return d.agg(F.count(F.lit(1)).alias("classes"), F.max("n").alias("max_count"), F.min("n").alias("min_count")) \
        .withColumn("ratio", F.col("max_count") / F.col("min_count")) \
        .withColumn("warn", F.col("ratio") > F.lit(warn_above))


def top_values(df: DataFrame, col: str, k: int = 10) -> DataFrame:
    """Most frequent values, ties by value."""
    return top_k_counts(df, col, k)


def top_null_columns(df: DataFrame, k: int = 10) -> DataFrame:
    """Columns with the most NULLs."""
    return null_counts(df).orderBy(F.col("nulls").desc(), F.col("column")).limit(k)


def alignment_counters(before: DataFrame, after: DataFrame, core: list[str]) -> dict:
    """Schema diff of an alignment (A17): renamed/added column counts."""
    b, a = set(before.columns), set(after.columns)
    return {"columns_before": len(b), "columns_after": len(a),
            "added": len([c for c in core if c in a and c not in b]), "kept": len(b & a)}


def feature_availability(df: DataFrame, group_col: str, defaults: dict) -> DataFrame:
    """Share of rows per group whose value differs from the column's
    default/sentinel (D18): 1.0 = always measured, 0.0 = never."""
    aggs = [F.avg((F.col(c) != F.lit(d)).cast("double")).alias(c) for c, d in defaults.items() if c in df.columns]
    return df.groupBy(group_col).agg(*aggs)
