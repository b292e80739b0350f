"""Model training and feature preparation with Spark ML.

The reference trains XGBoost on one machine; here the trees are Spark ML's
distributed gradient-boosted trees (not numerically equal to XGBoost), and
any foreign model can still be applied through `score.apply_model`.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import (Imputer, MinMaxScaler, OneHotEncoder, RobustScaler, StandardScaler,
                                StringIndexer, UnivariateFeatureSelector, VarianceThresholdSelector,
                                VectorAssembler)
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.exprs import zero_if_not_finite

# fixed values (P19): columns never used as model features
NON_FEATURES = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol", "timestamp", "app_label", "intent_label",
                "vpn_flag", "dataset_source", "source_file", "traffic_type", "label", "flow_id", "Label", "label_num"]
NUMERIC = ("int", "bigint", "smallint", "tinyint", "double", "float")


def feature_columns(df: DataFrame, exclude: list[str] | None = None) -> list[str]:
    """Numeric columns minus the exclusion list."""
    ex = set(NON_FEATURES) | set(exclude or [])
    return [c for c, t in df.dtypes if (t in NUMERIC or t.startswith("decimal")) and c not in ex]


def varying(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns that are not constant (one aggregate). A tree never splits on
    a constant feature, so dropping them leaves the model unchanged and
    saves the per-feature split search."""
    r = df.agg(*[(F.min(c) != F.max(c)).alias(f"v{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if r[f"v{i}"]]


def class_weights(df: DataFrame, label_col: str, out_col: str = "weight") -> DataFrame:
    """'balanced' weights n / (k * n_c) as a column (M12); the per-class
    table has one row per class."""
    n = df.count()
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("_nc"))
    k = counts.count()
    w = counts.select(label_col, (F.lit(float(n)) / (F.lit(float(k)) * F.col("_nc"))).alias(out_col))
    return df.join(w, on=label_col, how="inner")


def finite(df: DataFrame, features: list[str]) -> DataFrame:
    """+-inf / NaN -> 0."""
    return df.withColumns({c: zero_if_not_finite(F.col(c)) for c in features})


def prepare(df: DataFrame, features: list[str]) -> DataFrame:
    """+-inf / NaN -> 0 (P18), then a feature vector."""
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep") \
        .transform(finite(df, features))


def train_gbt(train: DataFrame, features: list[str], label_col: str = "y", *, max_iter: int = 200,
              max_depth: int = 6, step_size: float = 0.1, seed: int = 42, weight_col: str | None = None):
    """Gradient-boosted trees, 200 x depth 6, learning rate 0.1, logistic
    loss (M7). A single-class training set raises, as the reference guards."""
    if train.select(label_col).distinct().limit(2).count() < 2:
        raise ValueError("training data holds a single class")
    # a row finds its node by at most `max_depth` comparisons, which costs less
    # than an array of node ids kept for every row and rewritten at every level
    gbt = GBTClassifier(featuresCol="features", labelCol=label_col, maxIter=max_iter, maxDepth=max_depth,
                        stepSize=step_size, seed=seed, lossType="logistic", cacheNodeIds=False)
    if weight_col:
        gbt.setWeightCol(weight_col)
    # the boosting rounds re-read the training rows: cut the lineage once
    from flowlens.operators import boosting
    from flowlens.session import materialize
    cols = [*features, label_col, *([weight_col] if weight_col else [])]
    rows = materialize(train.select(*cols), "gbt-train")
    if max_depth > boosting.MAX_DEPTH:
        return gbt.fit(prepare(rows, features))
    # the trees of Spark ML's own `fit`, which walks over one object a row,
    # grown over arrays of bins
    return boosting.fit(gbt, finite(rows, features).withColumns({c: F.col(c).cast("double") for c in features}),
                        features)


def probability(model, df: DataFrame, features: list[str], out_col: str = "p") -> DataFrame:
    """P(class 1) from a fitted classifier, as a plain DOUBLE column."""
    from pyspark.ml.functions import vector_to_array
    return model.transform(prepare(df, features)).withColumn(out_col, vector_to_array("probability")[1])


def layout_pipeline(numeric: list[str], app_col: str = "app_class") -> Pipeline:
    """Feature layout of the documented second stage (M10): numeric block +
    one-hot application class."""
    idx = StringIndexer(inputCol=app_col, outputCol=f"{app_col}_idx", handleInvalid="keep")
    ohe = OneHotEncoder(inputCols=[f"{app_col}_idx"], outputCols=[f"{app_col}_ohe"])
    asm = VectorAssembler(inputCols=[*numeric, f"{app_col}_ohe"], outputCol="features", handleInvalid="keep")
    return Pipeline(stages=[idx, ohe, asm])


def scaler(kind: str, input_col: str = "features", output_col: str = "scaled"):
    """standard / minmax / robust scaler, to be fit on the training split only."""
    if kind == "standard":
        return StandardScaler(inputCol=input_col, outputCol=output_col, withMean=True, withStd=True)
    if kind == "minmax":
        return MinMaxScaler(inputCol=input_col, outputCol=output_col)
    if kind == "robust":
        return RobustScaler(inputCol=input_col, outputCol=output_col)
    raise ValueError(kind)


def missing_indicators(df: DataFrame, columns: list[str]) -> DataFrame:
    """<col>_missing flags."""
    return df.withColumns({f"{c}_missing": F.col(c).isNull().cast("int") for c in columns})


def median_imputer(columns: list[str]) -> Imputer:
    """Median fill."""
    return Imputer(inputCols=columns, outputCols=columns, strategy="median")


def zscore(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / std with the statistics of one aggregate pass."""
    st = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev(c).alias(f"s_{c}") for c in columns]).first()
    return df.withColumns({f"{c}_z": (F.col(c) - F.lit(st[f"m_{c}"])) / F.lit(st[f"s_{c}"])
                           if st[f"s_{c}"] else F.lit(0.0) for c in columns})


def select_k_best(k: int = 50, label_col: str = "y") -> UnivariateFeatureSelector:
    """ANOVA-F selection of the k best continuous features."""
    s = UnivariateFeatureSelector(featuresCol="features", outputCol="selected", labelCol=label_col,
                                  selectionMode="numTopFeatures")
    s.setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(k)
    return s


def variance_filter(threshold: float = 0.0) -> VarianceThresholdSelector:
    """Drop near-constant features."""
    return VarianceThresholdSelector(featuresCol="features", outputCol="selected", varianceThreshold=threshold)


def mutual_information(df: DataFrame, feature: str, label_col: str, bins: int = 10) -> DataFrame:
    """Mutual information (nats) between a binned feature and the label from
    joint counts (D12): equal-width bins between the feature's min and max."""
    mm = df.agg(F.min(feature).alias("lo"), F.max(feature).alias("hi")).first()
    lo, hi = float(mm["lo"] or 0.0), float(mm["hi"] or 0.0)
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.floor((F.col(feature) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))
    joint = df.where(F.col(feature).isNotNull()).groupBy(b.alias("b"), F.col(label_col).alias("y")) \
        .agg(F.count(F.lit(1)).alias("n"))
    n = joint.agg(F.sum("n")).first()[0] or 0
    pb = joint.groupBy("b").agg(F.sum("n").alias("nb"))
    py = joint.groupBy("y").agg(F.sum("n").alias("ny"))
    j = joint.join(pb, "b").join(py, "y")
    term = (F.col("n") / F.lit(float(n))) * F.log(F.col("n") * F.lit(float(n)) / (F.col("nb") * F.col("ny")))
    return j.agg(F.sum(term).alias("mi")).select(F.lit(feature).alias("feature"), "mi")


def mutual_informations(df: DataFrame, features: list[str], label_col: str, bins: int = 10) -> DataFrame:
    """`mutual_information` of several features with one label (D12): two scans,
    joint counts of all features in one shuffle, the margins from those counts."""
    from flowlens.operators.profile import binned

    def bin_of(x: Column, lo: Column, hi: Column) -> Column:
        width = F.when(hi > lo, (hi - lo) / F.lit(float(bins))).otherwise(F.lit(1.0))
        return F.least(F.floor((x - lo) / width), F.lit(bins - 1))

    joint = binned(df, {c: F.col(c).cast("double") for c in features}, [label_col], bin_of) \
        .groupBy(F.col("column").alias("feature"), "bin", F.col(label_col).alias("y")).agg(F.count(F.lit(1)).alias("n"))

    def margin(*keys: str) -> Column:
        return F.sum("n").over(Window.partitionBy(*keys))  # rows: features x bins x labels

    j = joint.select("feature", "n", margin("feature").alias("all"), margin("feature", "bin").alias("nb"),
                     margin("feature", "y").alias("ny"))
    all_ = F.col("all").cast("double")
    return j.groupBy("feature").agg(F.sum(F.col("n") / all_ * F.log(F.col("n") * all_ / (F.col("nb") * F.col("ny")))).alias("mi"))


def redundant_pairs(corr_long: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Feature pairs with |corr| > 0.9 (D12), from `profile.correlations`."""
    return corr_long.where(F.abs(F.col("corr")) > threshold)


def undersample(df: DataFrame, label_col: str, key_cols: list[str], *, target_ratio: float = 0.2,
                seed: int = 42) -> DataFrame:
    """Random undersampling (D10): every class larger than n_min / target_ratio
    keeps about that many rows, chosen by a seeded hash of the row key -- the
    same rows on every run and partitioning. Per-class sizes come from one
    aggregate (one row per class)."""
    counts = {r[label_col]: r["n"] for r in df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return df
    cap = min(counts.values()) / target_ratio
    frac = {k: min(1.0, cap / n) for k, n in counts.items()}
    m = F.create_map(*[F.lit(x) for kv in frac.items() for x in kv])
    from flowlens.operators.split import hash_order
    # uniform in [0, 1) from the md5(seed|key) digest used by the splits (same in SQL engines)
    u = F.conv(F.substring(hash_order(key_cols, seed), 1, 13), 16, 10).cast("double") / F.lit(float(16 ** 13))
    return df.where(u < F.element_at(m, F.col(label_col)))
