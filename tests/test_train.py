"""Spark ML helpers (M7, M10-M12, D12-D14) on a small labelled table."""
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from flowlens.operators import train as tr


def _data(spark):
    df = spark.range(0, 400).select(
        F.col("id"), (F.col("id") % 2).cast("int").alias("y"),
        (F.col("id") % 2 * 10 + F.col("id") % 7).cast("double").alias("a"),
        (F.col("id") % 5).cast("double").alias("b"), F.lit(1.0).alias("const"),
        F.when(F.col("id") % 3 == 0, F.lit("CHAT")).otherwise(F.lit("VOIP")).alias("app_class"))
    return df


def test_gbt_weights_and_probability(spark):
    df = _data(spark)
    w = tr.class_weights(df.where("id < 300 OR y = 1"), "y")
    ws = {r.y: round(r.weight, 6) for r in w.select("y", "weight").distinct().collect()}
    assert ws[0] > ws[1]
    model = tr.train_gbt(df, ["a", "b"], "y", max_iter=5, max_depth=2)
    p = tr.probability(model, df, ["a", "b"])
    acc = p.select(F.avg(((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("double"))).first()[0]
    assert acc > 0.95


def test_layout_scalers_selectors(spark):
    df = _data(spark)
    feats = tr.layout_pipeline(["a", "b", "const"]).fit(df).transform(df)
    train, test = feats.where("id < 300"), feats.where("id >= 300")
    sc = tr.scaler("minmax").fit(train)  # fit on the training split only
    out = sc.transform(test).select(vector_to_array("scaled").alias("v")).first().v
    assert len(out) == 3 + 2  # numeric block + one-hot app class (2 levels + unseen, last dropped)
    sel = tr.variance_filter(0.0).fit(feats).transform(feats)
    assert len(sel.select(vector_to_array("selected")).first()[0]) == 4  # the constant column is gone
    kb = tr.select_k_best(2, "y").fit(feats).transform(feats)
    assert len(kb.select(vector_to_array("selected")).first()[0]) == 2


def test_imputer_indicators_mi(spark):
    df = spark.createDataFrame([(1.0, 0), (None, 1), (3.0, 0), (5.0, 1)], "x double, y int")
    ind = tr.missing_indicators(df, ["x"])
    assert [r.x_missing for r in ind.collect()] == [0, 1, 0, 0]
    imp = tr.median_imputer(["x"]).fit(df).transform(df)
    assert imp.where("x IS NULL").count() == 0
    mi = tr.mutual_information(_data(spark), "a", "y").first().mi
    assert mi > 0.5  # `a` separates the classes
