"""Readers for the driver's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowlens.session import configure

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def spread(df: DataFrame) -> DataFrame:
    """Round-robin the rows over the cluster's cores when the scan yields
    fewer splits than cores. For compute-bound operators only (a small file has
    one row group, so one task would run all their per-row work): reading a
    table never shuffles."""
    try:
        spark = df.sparkSession
        cores = spark.sparkContext.defaultParallelism
        splits = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - e.g. a Connect session without RDD access: leave the scan as is
        return df
    return df.repartition(cores) if splits < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table; column pruning and filters reach the scan."""
    if name not in TABLES:
        raise KeyError(name)
    configure(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
