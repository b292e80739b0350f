"""Feature drift against a stored reference.

The state of a feature is a histogram whose cells have a bounded relative width,
so it is a quantile sketch that merges by adding counts: states of days, files
or stream batches are written as a table, added up later, and compared without
reading the rows again. Cells are fixed by the value alone, not by the data, so
a merged state equals the state of all rows together.

A value is |x| * UNIT rounded down to an integer v; its cell is v's highest
DIGITS bits and the number of bits below them. Values under 2^DIGITS have cells
of their own, others one of 2^(DIGITS - 1) cells for each power of two, at most
1/32 of the value wide; a feature has fewer than 3,400 cells however many rows
it has. Null and NaN are one cell (null), kept out of the bins and reported as
their share; |x| * UNIT beyond 2^53, infinities included, is cut off there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.monitor import DRIFT_ALERT

UNIT = 1000
DIGITS = 6
MOST = float(1 << 53)
EPS = 1e-6


def cell(x: Column) -> Column:
    """The cell of a number; cells are ordered as the values are."""
    x = x.cast("double")
    v = F.floor(F.least(F.abs(x) * F.lit(float(UNIT)), F.lit(MOST))).cast("bigint")
    low = F.greatest(F.length(F.bin(v)) - F.lit(DIGITS), F.lit(0))
    k = low * F.lit(1 << DIGITS) + F.call_function("shiftright", v, low)
    return F.when(x.isNull() | F.isnan(x), F.lit(None).cast("bigint")).when(x < 0, -k - 1).otherwise(k)


def cell_floor(k: Column) -> Column:
    """The value of a cell that is nearest to 0."""
    at = F.when(k < 0, -k - 1).otherwise(k)
    low = F.call_function("shiftright", at, F.lit(DIGITS)).cast("int")
    v = F.call_function("shiftleft", at.bitwiseAND(F.lit((1 << DIGITS) - 1)).cast("bigint"), low)
    return F.when(k < 0, -v).otherwise(v) / F.lit(float(UNIT))


def feature_state(df: DataFrame, features: list[str], by: list[str] | None = None) -> DataFrame:
    """(*by, feature, cell, n) of all features in one scan; counts are added up
    in the tasks before the shuffle, which holds a task's cells at most. `by`
    columns (a day, a model version) must not be called feature, cell or n."""
    by = list(by or [])
    if clash := {"feature", "cell", "n"} & set(by):
        raise ValueError(f"columns of `by` must have other names: {sorted(clash)}")
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), cell(F.col(f"`{f}`")).alias("cell")) for f in features])
    return df.select(*by, F.inline(pairs)).groupBy(*by, "feature", "cell").agg(F.count(F.lit(1)).alias("n"))


def merge_states(*states: DataFrame) -> DataFrame:
    """The state of all rows that the states were made of; `by` columns go."""
    parts = [s.select("feature", "cell", "n") for s in states]
    return reduce(DataFrame.unionByName, parts).groupBy("feature", "cell").agg(F.sum("n").alias("n"))


def state_quantiles(state: DataFrame, probs: list[float]) -> DataFrame:
    """(feature, prob, value): the first cell up to which at least that share of
    a feature's values lies, as its value nearest to 0."""
    w = Window.partitionBy("feature")
    ranked = state.where("cell IS NOT NULL").select(
        "feature", "cell", F.sum("n").over(w.orderBy("cell")).alias("upto"), F.sum("n").over(w).alias("total"))
    asked = ranked.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    return asked.where(F.col("upto") >= F.col("prob") * F.col("total")).groupBy("feature", "prob") \
        .agg(F.min("cell").alias("cell")).select("feature", "prob", cell_floor(F.col("cell")).alias("value"))


def state_drift(reference: DataFrame, live: DataFrame, bins: int = 10) -> DataFrame:
    """One row a feature of either state: n_train, n_live (values), the shares
    of missing ones, the bins in use, the population stability index and the
    alert of D6. A cell's bin is its rank among the reference's values, so bins
    are cut where the reference's quantiles are, at borders of cells. A feature
    without values on one side has no index and no alert."""
    both = reference.select("feature", "cell", F.col("n").alias("r"), F.lit(0).cast("bigint").alias("l")).unionByName(
        live.select("feature", "cell", F.lit(0).cast("bigint").alias("r"), F.col("n").alias("l")))
    both = both.groupBy("feature", "cell").agg(F.sum("r").alias("r"), F.sum("l").alias("l"))
    w = Window.partitionBy("feature")  # the cells of a feature: a bounded number of rows
    known = F.col("cell").isNotNull()
    ranked = both.select(
        "feature", "cell", "r", "l",
        *[F.coalesce(F.sum(F.when(known, F.col(c))).over(w), F.lit(0)).alias(f"{c}_all") for c in "rl"],
        F.coalesce(F.sum(F.when(known, F.col("r"))).over(w.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("under"))
    place = F.when(known & (F.col("r_all") > 0),
                   F.least(F.expr(f"under * {bins} div r_all"), F.lit(bins - 1).cast("bigint")))
    binned = ranked.withColumn("bin", place).groupBy("feature", "r_all", "l_all", known.alias("known"), "bin") \
        .agg(F.sum("r").alias("r"), F.sum("l").alias("l"))
    p, q = (F.greatest(F.col(c) / F.col(f"{c}_all"), F.lit(EPS)) for c in "rl")
    measured = F.col("known") & (F.col("r_all") > 0) & (F.col("l_all") > 0)
    missing = [F.coalesce(F.sum(F.when(~F.col("known"), F.col(c))), F.lit(0)) for c in "rl"]
    share = [F.when(m + F.col(f"{c}_all") > 0, m / (m + F.col(f"{c}_all"))) for m, c in zip(missing, "rl")]
    out = binned.groupBy("feature", "r_all", "l_all").agg(
        share[0].alias("missing_train"), share[1].alias("missing_live"), F.count_if(F.col("known")).alias("bins"),
        F.sum(F.when(measured, (q - p) * F.log(q / p))).alias("psi"))
    return out.select("feature", F.col("r_all").alias("n_train"), F.col("l_all").alias("n_live"), "missing_train",
                      "missing_live", "bins", "psi", F.coalesce(F.col("psi") > DRIFT_ALERT, F.lit(False)).alias("drift_alert"))
