"""Stage subsets and deterministic stratified splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.operators.topk import ordinal_within_group


def stage1(df: DataFrame) -> DataFrame:
    """Application-classification subset: known app labels only."""
    return df.where(F.col("app_label") != "Unknown")


def stage2(df: DataFrame, relabel_unknown: bool = False) -> DataFrame:
    """Intent-classification set: all rows; optionally Unknown -> Unclassified."""
    if not relabel_unknown:
        return df
    return df.withColumn("intent_label", F.when(F.col("intent_label") == "Unknown", F.lit("Unclassified"))
                         .otherwise(F.col("intent_label")))


def hash_order(key_cols: list[str], seed: int = 42):
    """md5(seed|key...) -- the same digest in DuckDB, independent of partitioning."""
    parts = [F.lit(str(seed))] + [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key_cols]
    return F.md5(F.concat_ws("|", *parts))


def stratified_split(df: DataFrame, label_col: str, key_cols: list[str], *,
                     holdout: float = 0.3, test_share: float = 0.5, seed: int = 42,
                     stratify: bool = True, bucket_hex_digits: int = 4) -> DataFrame:
    """Adds `split` in {'train', 'val', 'test'} (M1).

    Per class (or over all rows when stratify=False or there is a single
    class) rows are ordered by md5(seed|key); the first floor(n * holdout)
    form the hold-out, of which the first floor(h * test_share) are 'test'
    and the rest 'val'. test_share=1.0 gives a two-way train/test split
    (80/20: holdout=0.2). Ordinals are counted per (class, digest prefix),
    so a class holding most rows is still spread over many tasks.
    """
    d = df.withColumn("_h", hash_order(key_cols, seed))
    # one class or no stratification: the whole table is one group (grouping
    # by a single-valued label gives the same ordinals)
    group = [label_col] if stratify else []
    # the leading hex digits of the digest are a bucket that follows the order
    # (never null, which the planner must see: else it tests the digest for null
    # at the scan, with all expressions of its keys written out once more)
    bucket = F.coalesce(F.conv(F.substring("_h", 1, bucket_hex_digits), 16, 10).cast("bigint"), F.lit(0))
    d = ordinal_within_group(d, group, ["_h", *key_cols], bucket, name="_ord") \
        .withColumnRenamed("_ord_group_size", "_n")
    n_hold = F.floor(F.col("_n") * F.lit(holdout))
    n_test = F.floor(n_hold * F.lit(test_share))
    split = (F.when(F.col("_ord") < n_test, F.lit("test"))
              .when(F.col("_ord") < n_hold, F.lit("val"))
              .otherwise(F.lit("train")))
    return d.withColumn("split", split).drop("_h", "_ord", "_n")
