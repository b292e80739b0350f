"""Exact deduplication by a distributed sort of the normalised contents.

Texts are folded (A-Z to a-z), range-partitioned by Spark's sampled splitters
on the first HEAD code points of the folded text and, where many texts begin
alike, its digest (so that the sampled keys stay short), and sorted externally,
so that equal texts are neighbours; the window over equal neighbours compares
whole texts and names the row that stays. Texts that fill a large share of a
range are found first by their digests (a partial aggregate; at most
`4 x ranges` of them by construction) and sorted in several parts, whose
results are joined by digest afterwards.

`distinct_contents` gives the rows that stay, whole: they take part in the sort
as they are, so they cross the network once and nothing is joined to them after.

All of it is DataFrame operations.

Defined results: a null text equals the empty text; of rows with the same id
and text one stays (any, they are the same); a null id loses against every
other; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.session import Scratch, configure

HEAD = 64
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def content_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       keep: str = "largest") -> DataFrame:
    """One row per row of `docs`: id, keep_id (the id that stays of the equal
    texts, the `smallest` or `largest`), group_size, kept, text_sha256."""
    spark = configure(docs.sparkSession)
    scratch = Scratch(spark, "content-sort")
    ranges = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    folded = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, UPPER.lower())
    rows = scratch.write(
        docs.select(F.col(id_col).cast("long").alias("id"), folded.alias("body"))
        .withColumn("text_sha256", F.sha2("body", 256)), "folded")

    total = rows.count()
    per_part = max(1, total // (4 * ranges))
    heavy = scratch.write(
        rows.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > max(1, per_part)),
        "heavy")  # at most 4 * ranges rows
    parts = F.coalesce(F.ceil(F.col("copies") / per_part).cast("int"), F.lit(1))
    dealt = rows.join(F.broadcast(heavy), "text_sha256", "left") \
        .withColumn("part", F.coalesce(F.pmod(F.xxhash64("id"), parts), F.lit(0)).cast("int")) \
        .withColumn("head_of", F.substring("body", 1, HEAD)) \
        .repartitionByRange(ranges, "head_of", "text_sha256", "part")
    first = F.col("id").desc_nulls_last() if keep == "largest" else F.col("id").asc_nulls_last()
    equal = Window.partitionBy("head_of", "text_sha256", "body", "part")
    sorted_rows = scratch.write(
        dealt.select("id", "text_sha256", F.col("copies").isNotNull().alias("split"),
                     F.first("id").over(equal.orderBy(first)).alias("head"),
                     F.row_number().over(equal.orderBy(first)).alias("place"),
                     F.count(F.lit(1)).over(equal).alias("size")), "sorted")
    best = F.max("head") if keep == "largest" else F.min("head")
    joined = sorted_rows.where("split and place = 1").groupBy("text_sha256") \
        .agg(best.alias("best"), F.sum("size").alias("all"))  # at most 4 * ranges rows
    out = sorted_rows.join(F.broadcast(joined), "text_sha256", "left")
    keep_id = F.when(F.col("split"), F.col("best")).otherwise(F.col("head"))
    out = scratch.write(
        out.select(F.col("id").alias(id_col), keep_id.alias("keep_id"),
                   F.coalesce("all", "size").cast("long").alias("group_size"),
                   ((F.col("place") == 1) & F.col("head").eqNullSafe(keep_id)
                    & (~F.col("split") | F.col("id").isNotNull() | F.col("best").isNull())).alias("kept"),
                   "text_sha256"), "result")
    scratch.keep_only("result")
    return out


def distinct_contents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of `docs` that stay, one of each group of equal texts: that with
    the `smallest` or `largest` id, and any one of several rows with that id.
    Columns are those of `docs`, whatever their names."""
    spark = configure(docs.sparkSession)
    scratch = Scratch(spark, "content-rows")
    ranges = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    body = F.translate(F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit("")), UPPER, UPPER.lower())
    keyed = rows.withColumn("digest", F.unhex(F.sha2(body, 256)))
    copies = scratch.write(keyed.groupBy("digest").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "copies")
    repeated = copies.agg(F.sum("copies")).first()[0] or 0
    per_part = max(1, repeated // (4 * ranges))
    heavy = copies.where(F.col("copies") > per_part)  # at most 4 * ranges rows
    parts = F.coalesce(F.ceil(F.col("copies") / per_part).cast("int"), F.lit(1))
    head = F.substring(body, 1, HEAD)
    dealt = keyed.join(F.broadcast(heavy), "digest", "left") \
        .withColumn("part", F.pmod(F.xxhash64(F.col(f"row.`{id_col}`")), parts).cast("int")) \
        .withColumn("head", head).repartitionByRange(ranges, "head", "digest", "part")
    id_of = F.col(f"row.`{id_col}`")
    best = id_of.desc_nulls_last() if keep == "largest" else id_of.asc_nulls_last()
    equal = Window.partitionBy("head", "digest", body, "part").orderBy(best)
    first = dealt.withColumn("place", F.row_number().over(equal)).where("place = 1")
    # a text in several parts: one row of each part is left
    again = Window.partitionBy("digest", body).orderBy(best)
    joined = first.where("copies is not null").withColumn("place", F.row_number().over(again)).where("place = 1")
    return first.where("copies is null").select("row.*").unionByName(joined.select("row.*"))
