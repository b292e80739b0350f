from pyspark.sql import functions as F

from flowlens.llm.components import _state


def test_tables_of_one_size_are_told_apart(spark):
    edges = spark.range(1, 20_000).select(F.col("id").alias("u"), F.lit(0).cast("long").alias("v"))
    seen = {}
    for u, rest in edges.select("u", F.xxhash64("u", "v") % 1_000_003).collect():
        if rest in seen:  # their hashes are alike but for a multiple of 1,000,003
            assert _state(edges.where(F.col("u") == u)) != _state(edges.where(F.col("u") == seen[rest]))
            return
        seen[rest] = u
    raise AssertionError("no such edges")
