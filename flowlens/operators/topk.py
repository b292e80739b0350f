"""Top-k and row caps (T2-T5, W5) that stay safe on hot groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_n_per_group(df: DataFrame, group_cols: list[str], order_cols: list, n: int) -> DataFrame:
    """First `n` rows per group under a total order (T5).

    Two rounds: the first keeps the local top n of every (group, input
    partition) -- no shuffle on the group yet -- so a group holding a third of
    the table still reaches the final window with at most n rows per input
    partition. The global top n is a subset of the union of local ones.
    """
    pre = (df.withColumn("_pid", F.spark_partition_id())
             .withColumn("_rn", F.row_number().over(
                 Window.partitionBy(*group_cols, "_pid").orderBy(*order_cols)))
             .where(F.col("_rn") <= n).drop("_rn", "_pid"))
    w = Window.partitionBy(*group_cols).orderBy(*order_cols) if group_cols else Window.orderBy(*order_cols)
    if not group_cols:
        return pre.orderBy(*order_cols).limit(n)
    return pre.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def top_k_counts(df: DataFrame, key: str, k: int, count_name: str = "count") -> DataFrame:
    """groupBy(key).count() -> k largest, ties broken by key."""
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias(count_name))
              .orderBy(F.col(count_name).desc(), F.col(key).asc_nulls_first()).limit(k))


def first_per_key(df: DataFrame, key_cols: list[str], order_cols: list) -> DataFrame:
    """Keep-first dedupe (A1-A3, W5): the first row of every key under an
    explicit total order. Spark keeps the first row of a key in each task before
    the shuffle (a group limit on the rank), so a key sends one row a task
    however often it occurs, and rows cross the network once, as they are."""
    order = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    w = Window.partitionBy(*key_cols).orderBy(*order)
    return df.withColumn("_first", F.row_number().over(w)).where(F.col("_first") == 1).drop("_first")


def ordinal_within_group(df: DataFrame, group_cols: list[str], order_cols: list, bucket,
                         name: str = "_ord") -> DataFrame:
    """0-based row number of every row inside its group under a total order,
    without sending a whole group to one task (W6, M1).

    `bucket` is an integer column that never decreases along the order (for
    a hash order: a prefix of the hash). Rows are numbered inside each
    (group, bucket) window; a small table of per-(group, bucket) counts gives
    the number of rows of earlier buckets, which is added back. Everything is
    a function of the row values, so re-executed or re-partitioned branches
    always agree.
    """
    okeys = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    d = df.withColumn("_bkt", bucket)
    local = Window.partitionBy(*group_cols, "_bkt").orderBy(*okeys)
    d = d.withColumn("_lrn", F.row_number().over(local) - 1)
    # counts come from the windowed rows themselves, so both branches share
    # one shuffle (exchange reuse) and the input is computed once
    counts = d.groupBy(*group_cols, "_bkt").agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.partitionBy(*group_cols).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group_cols)
    offsets = counts.select(*group_cols, "_bkt", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"),
                            F.sum("_cnt").over(whole).alias(f"{name}_group_size"))
    return (d.join(offsets, on=[*group_cols, "_bkt"], how="inner")
             .withColumn(name, (F.col("_off") + F.col("_lrn")).cast("bigint"))
             .drop("_bkt", "_lrn", "_off"))


def range_buckets(df: DataFrame, col: str, n: int = 256, accuracy: int = 10_000):
    """Integer bucket column for `col` from approximate quantile cut points
    (one sketch aggregate; the cut points come back as a short literal list).
    The bucket never decreases as `col` grows."""
    probs = [i / n for i in range(1, n)]
    cuts = df.select(F.percentile_approx(F.col(col).cast("double"), probs, accuracy)).first()[0] or []
    cuts = sorted(set(float(c) for c in cuts if c is not None))
    arr = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<double>")
    return F.size(F.filter(arr, lambda c: c <= F.col(col).cast("double")))


def prefix_sums(df: DataFrame, group_cols: list[str], order_col: str, value_cols: list[str], *,
                descending: bool = False, prefix: str = "before_", buckets: int = 256) -> DataFrame:
    """For every row, the sums of `value_cols` over the rows strictly before
    it in its group when ordered by `order_col` (values distinct per group).

    Rows are cut into value ranges (`range_buckets`); running sums are taken
    inside each (group, range) window and the totals of earlier ranges are
    added from a small per-(group, range) table -- a running total with no
    single-task window and no dependence on physical partition numbers.
    """
    b = range_buckets(df, order_col, buckets)
    if descending:
        b = F.lit(buckets + 1) - b
    o = F.col(order_col).desc() if descending else F.col(order_col).asc()
    d = df.withColumn("_bkt", b)
    local = Window.partitionBy(*group_cols, "_bkt").orderBy(o).rowsBetween(Window.unboundedPreceding, -1)
    for v in value_cols:
        d = d.withColumn(f"_l_{v}", F.coalesce(F.sum(v).over(local), F.lit(0)))
    tot = df.withColumn("_bkt", b).groupBy(*group_cols, "_bkt").agg(*[F.sum(v).alias(f"_t_{v}") for v in value_cols])
    before = Window.partitionBy(*group_cols).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(*group_cols, "_bkt",
                      *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in value_cols])
    out = d.join(offs, on=[*group_cols, "_bkt"], how="inner")
    for v in value_cols:
        out = out.withColumn(f"{prefix}{v}", F.col(f"_o_{v}") + F.col(f"_l_{v}"))
    return out.drop("_bkt", *[f"_{k}_{v}" for k in ("l", "o") for v in value_cols])
