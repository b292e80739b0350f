"""Order-dependent columns that stay distributed: the previous value within a
key (D3) and the position in a global sort (T1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.topk import ordinal_within_group, range_buckets


def previous_in_key(df: DataFrame, key_cols: list[str], value: str, t_us: Column, order_cols: list[str], *,
                    name: str = "previous", bucket_us: int = 3_600_000_000) -> DataFrame:
    """`value` of the row before, in the order of (t_us, order_cols), among the
    rows with the same key; null for a key's first row.

    The window runs over a key's rows of one time bucket. The first row of a
    bucket takes the last value of the key's bucket before it, from a table of
    one row for each key and bucket, so a key that holds a third of all rows is
    spread over its buckets. `bucket_us` changes parallelism, never the result.
    """
    d = df.withColumn("_t", t_us).withColumn("_b", F.floor(F.col("_t") / F.lit(bucket_us)).cast("bigint")) \
        .withColumn("_o", F.struct("_t", *order_cols)).withColumn("_v", F.struct(F.col(value).alias("v")))
    inside = Window.partitionBy(*key_cols, "_b").orderBy("_o")
    d = d.withColumn("_prev", F.lag("_v").over(inside))
    last = d.groupBy(*key_cols, "_b").agg(F.max_by("_v", "_o").alias("_last"))
    carried = last.select(*key_cols, "_b", F.lag("_last").over(Window.partitionBy(*key_cols).orderBy("_b")).alias("_carry"))
    # null keys are one key, as in a window
    same = F.lit(True)
    for c in [*key_cols, "_b"]:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    j = d.alias("a").join(carried.alias("b"), same, "left")
    return j.select(*[F.col(f"a.{c}") for c in df.columns], F.coalesce("a._prev", "b._carry")["v"].alias(name))


def sort_positions(df: DataFrame, text_col: str, parsed: Column, input_order: list[str], *, strict: bool = True,
                   name: str = "position", buckets: int = 256) -> DataFrame:
    """0-based position of every row when sorted by `parsed` (a timestamp from
    `text_col`), missing values first, ties in input order (T1). With `strict`
    one value that is there but can't be parsed cancels the sort: all rows keep
    their input order; without it such values count as missing.

    Positions are counted per range of times and offset by the ranges before,
    so no task sorts the table."""
    d = df.withColumn("_ts", F.unix_micros(parsed))
    if strict:
        there = F.coalesce(F.trim(F.col(text_col).cast("string")), F.lit("")) != ""
        spoilt = d.agg(F.coalesce(F.max((there & F.col("_ts").isNull()).cast("int")), F.lit(0))).scalar()
        # without the sort, rows lie in ranges of their input order
        d = d.withColumn("_spoilt", spoilt == 1)
        d = d.withColumn("_ts", F.when(~F.col("_spoilt"), F.col("_ts")))
        place = F.when(F.col("_spoilt"), range_buckets(df, input_order[0], buckets)) \
            .otherwise(F.coalesce(range_buckets(d, "_ts", buckets), F.lit(-1)))
    else:
        place = F.coalesce(range_buckets(d, "_ts", buckets), F.lit(-1))
    place = F.when(F.col("_ts").isNull() & ~(F.col("_spoilt") if strict else F.lit(False)), F.lit(-1)).otherwise(place)
    d = ordinal_within_group(d, [], [F.col("_ts").asc_nulls_first(), *input_order], place, name=name)
    return d.drop("_ts", "_spoilt", f"{name}_group_size")
