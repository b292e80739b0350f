"""Connected components of a link table by alternating star contractions.

Each round hands every neighbour to the smallest vertex known nearby, so the
number of rounds grows with the logarithm of the size and no vertex list is
gathered anywhere; the smallest neighbour is a partial aggregate, so a vertex
with very many links costs one row a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.session import Scratch


def _state(edges: DataFrame) -> tuple:
    sums = [F.sum(h.cast("decimal(20,0)")) for h in (F.xxhash64("u", "v"), F.xxhash64(F.lit(1), "v", "u"))]
    row = edges.agg(F.count(F.lit(1)), *sums).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    hooked = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hooked.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v")


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(u, v) links -> (u, v) with v the smallest vertex of u's component, for
    every vertex but those smallest ones. Loops and repeated links don't matter;
    no links give no rows."""
    edges = scratch.write(links.select("u", "v").where("u <> v").distinct(), f"{name}-0")
    state, k = None, 0
    while (now := _state(edges)) != state:
        state, k = now, k + 1
        edges = scratch.write(_small_star(_large_star(edges).distinct()).distinct(), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
    return edges
