"""Interval join: addresses to the narrowest range that holds them.

Ranges may nest, as network prefixes do, and any number of addresses may fall
into one of them. Bounds and addresses are merged on one number line:

1. Ranges that nest are cut at all bounds into elementary intervals, each with
   the narrowest range over it, found for each bound among the ranges that cover
   it (as many as nest there). This table has two rows a range at the most.
2. The line is cut into slices by approximate quantiles of the addresses, so
   that a crowded network is spread over many slices; one address that holds
   more than a slice is looked up by itself, and its rows stay where they are.
3. In a slice, addresses and the starts of elementary intervals are sorted
   together and every address takes the last start before it. The start that
   covers a slice's beginning is carried into it from the slices before, from a
   table of one row for each slice.

No range is copied into every bucket that it covers, and no task gets all
addresses of a network.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES = 256


def elementary(ranges: DataFrame, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """(lo, hi, ...) nesting ranges -> (at, range): from `at` on, up to the next
    row, `range` is the narrowest range (a struct of all columns; ties to the
    smallest lo, then the least of the other columns), or null.

    Cutting points are joined to the ranges that cover them through cells: a
    range lies in the one or two cells as wide as itself (to the next power of
    two) that it touches, a point in one cell of every width that occurs."""
    whole = F.struct(*[F.col(c) for c in ranges.columns])
    r = ranges.select(F.col(lo).cast("bigint").alias("lo"), F.col(hi).cast("bigint").alias("hi"), whole.alias("range")) \
        .where("lo <= hi")
    cuts = r.select(F.col("lo").alias("at")).unionByName(r.select((F.col("hi") + 1).alias("at"))).distinct()
    # levels: a range belongs to the level of its width, where it touches two cells at the most
    level = F.ceil(F.log2(F.col("hi") - F.col("lo") + 1)).cast("int")
    placed = r.withColumn("level", level).withColumn("cell", F.explode(F.array_distinct(F.array(
        F.expr("shiftright(lo, level)"), F.expr("shiftright(hi, level)")))))
    levels = [row[0] for row in placed.select("level").distinct().collect()]  # 33 at the most for IPv4
    asked = cuts.withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels]) if levels else F.array().cast("array<int>"))) \
        .withColumn("cell", F.expr("shiftright(at, level)"))
    over = asked.join(placed, ["level", "cell"]).where("at between lo and hi")
    narrowest = over.groupBy("at").agg(F.min(F.struct((F.col("hi") - F.col("lo")).alias("width"), "lo", "range")).alias("best"))
    return cuts.join(narrowest, "at", "left").select("at", F.col("best.range").alias("range"))


def narrowest_range(df: DataFrame, number: Column, ranges: DataFrame, *, name: str = "range",
                    slices: int = SLICES) -> DataFrame:
    """`df` with the narrowest range over `number`, a struct of the columns of
    `ranges` (which has lo and hi), or null; null numbers have none. Rows of
    `df` stay as many as they are. `slices` changes parallelism, never the result."""
    starts = elementary(ranges)
    d = df.withColumn("_x", number.cast("bigint"))
    probs = [i / slices for i in range(1, slices)]
    cuts = d.select(F.percentile_approx("_x", probs, 10_000)).first()[0] or []  # `slices` numbers
    often = sorted({c for c in cuts if cuts.count(c) > 1})  # numbers that fill more than a slice
    edges = sorted(set(cuts) | {c + 1 for c in often})

    def slice_of(x: Column) -> Column:
        at = F.array(*[F.lit(c).cast("bigint") for c in edges]) if edges else F.array().cast("array<bigint>")
        return F.size(F.filter(at, lambda c: c <= x))

    known = starts.withColumn("_s", slice_of(F.col("at")))
    # the last start of the slices before each slice: one row a slice
    last = known.groupBy("_s").agg(F.max_by("range", "at").alias("_range"), F.max("at").alias("_at"))
    every = df.sparkSession.range(len(edges) + 1).select(F.col("id").cast("int").alias("_s")) \
        .join(last, "_s", "left")
    before = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select("_s", F.last(F.when(F.col("_at").isNotNull(), F.struct("_range")), ignorenulls=True).over(before)
                           .alias("_carry"))

    # nulls, and numbers that fill more than a slice, are dealt out to slices without starts and
    # looked up by themselves: as many look-ups as such numbers, at most `slices`
    aside = F.col("_x").isNull() | (F.col("_x").isin(often) if often else F.lit(False))
    anywhere = (-1 - F.pmod(F.monotonically_increasing_id(), F.lit(slices))).cast("int")
    held = [f"_c{i}" for i in range(len(df.columns))]
    empty = F.lit(None).cast(starts.schema["range"].dataType)
    rows = d.select(*[F.col(f"`{c}`").alias(h) for c, h in zip(df.columns, held)], F.lit(1).alias("_asks"),
                    F.when(aside, anywhere).otherwise(slice_of(F.col("_x"))).alias("_s"), F.col("_x").alias("at"),
                    empty.alias("range"))
    nothing = [F.lit(None).cast(f.dataType).alias(h) for f, h in zip(df.schema.fields, held)]
    both = rows.unionByName(known.select(*nothing, F.lit(0).alias("_asks"), "_s", "at", "range"))
    # a start comes before the addresses at the same place
    order = Window.partitionBy("_s").orderBy("at", "_asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_found", F.last(F.when(F.col("_asks") == 0, F.struct("range")), ignorenulls=True).over(order)) \
        .where("_asks = 1").join(F.broadcast(carried), "_s", "left")
    answer = F.when(F.col("_found").isNotNull(), F.col("_found.range")).otherwise(F.col("_carry._range"))
    if often:
        points = df.sparkSession.createDataFrame([(int(c),) for c in often], "_often bigint")
        answers = starts.join(F.broadcast(points), F.col("at") <= F.col("_often")) \
            .groupBy("_often").agg(F.max_by(F.struct("range"), "at").alias("_answer"))
        found = found.join(F.broadcast(answers), F.col("at") == F.col("_often"), "left")
        answer = F.when(F.col("_answer").isNotNull(), F.col("_answer.range")).otherwise(answer)
    return found.select(*[F.col(h).alias(c) for h, c in zip(held, df.columns)], answer.alias(name))
