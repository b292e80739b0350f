"""M7: trees grown over blocks of bins are those of Spark ML."""
import datetime
import os

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.sql import functions as F

from flowlens.operators import boosting
from flowlens.operators import split as sp
from flowlens.operators import train as tr


def _rows(spark, n=3000):
    u = [F.rand(i) for i in range(4)]
    return spark.range(0, n, 1, 3).select(
        "id", (u[0] * 10 - 5).alias("a"), F.floor(u[1] * 7).cast("double").alias("b"), (u[2] * u[2]).alias("c"),
        (F.col("id") % 4).cast("double").alias("w"), u[3].alias("u")).withColumn(
        "y", (F.col("u") < 1 / (1 + F.exp(-F.col("a") * F.col("b") / 9 + F.col("c")))).cast("int")).localCheckpoint()


@pytest.mark.parametrize(("weight", "one_task"), [(None, False), ("w", False), (None, True), ("w", True)])
def test_same_trees_as_spark_ml(spark, tmp_path, monkeypatch, weight, one_task):
    if not one_task:
        monkeypatch.setattr(boosting, "ONE_TASK_ROWS", 0)
    monkeypatch.setattr(boosting, "CHECKPOINT_EVERY", 2)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 500)
    df, feats = _rows(spark), ["a", "b", "c"]
    plain = GBTClassifier(featuresCol="features", labelCol="y", maxIter=5, maxDepth=4, stepSize=0.1, seed=42,
                          lossType="logistic")
    if weight:
        plain.setWeightCol(weight)
    want = plain.fit(tr.prepare(df, feats))
    got = tr.train_gbt(df, feats, "y", max_iter=5, max_depth=4, weight_col=weight)
    assert isinstance(got, GBTClassificationModel) and got.treeWeights == want.treeWeights
    assert got.totalNumNodes == want.totalNumNodes
    assert np.allclose(got.featureImportances.toArray(), want.featureImportances.toArray())
    p = tr.probability(got, df, feats, "p").select("id", "p").join(
        tr.probability(want, df, feats, "q").select("id", "q"), "id")
    assert p.where(F.abs(F.col("p") - F.col("q")) > 1e-9).count() == 0
    got.write().overwrite().save(str(tmp_path / "model"))
    assert GBTClassificationModel.load(str(tmp_path / "model")).totalNumNodes == want.totalNumNodes
    kept = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    assert not [d for d in os.listdir(kept) if d.startswith("rdd-") and os.listdir(f"{kept}/{d}")]


def test_spark_mls_own_fit_is_left_to_deep_trees(spark, monkeypatch):
    def refuse(*_):
        raise RuntimeError("own fit")
    monkeypatch.setattr(GBTClassifier, "_fit", refuse)
    df = _rows(spark, 200)
    assert tr.train_gbt(df, ["a"], "y", max_iter=2, max_depth=2).getNumTrees == 2
    with pytest.raises(RuntimeError, match="own fit"):
        tr.train_gbt(df, ["a"], "y", max_iter=1, max_depth=boosting.MAX_DEPTH + 1)


def test_nothing_to_split_on_and_values_that_are_no_numbers(spark):
    df = spark.createDataFrame([(1.0, float("nan"), 0), (1.0, None, 1), (1.0, 0.0, 1)], "a double, b double, y int")
    model = tr.train_gbt(df, ["a", "b"], "y", max_iter=2, max_depth=3)
    assert [t.numNodes for t in model.trees] == [1, 1]
    assert {r.p > 0.5 for r in tr.probability(model, df, ["a", "b"]).collect()} == {True}


@pytest.mark.parametrize("row", [(1.0, 2), (1.0, None)])
def test_other_labels_are_refused(spark, row):
    df = spark.createDataFrame([(1.0, 0), (2.0, 1), row], "a double, y int")
    with pytest.raises(ValueError, match="1 rows"):
        tr.train_gbt(df, ["a"], "y", max_iter=1)


def test_thresholds():
    assert list(boosting.thresholds({1.0: 2.0, 3.0: 1.0}, 3.0, 3, 31)) == [2.0]
    assert list(boosting.thresholds({1.0: 2.0}, 3.0, 3, 31)) == [0.5]  # the rest are zeros
    assert list(boosting.thresholds({float(v): 1.0 for v in range(1, 9)}, 8.0, 8, 1)) == [4.5]


def test_the_split_reads_no_digest_at_the_scan(spark, tmp_path):
    df = spark.range(100).select(F.concat(F.lit("10."), F.col("id").cast("string")).alias("k"),
                                 (F.col("id") % 2).cast("int").alias("y"))
    df.write.parquet(str(tmp_path / "t"))
    plan = sp.stratified_split(spark.read.parquet(str(tmp_path / "t")), "y", ["k"])._jdf.queryExecution()
    filters = [x for x in plan.optimizedPlan().toString().splitlines() if "Filter" in x]
    assert not any("md5" in x for x in filters)


def test_the_split_reads_deduplicated_flows(spark, tmp_path, monkeypatch):
    from flowlens.plans import catalog

    class Done(Exception):
        pass
    seen = []

    def split(rows, *_args, **_options):
        seen.extend(rows.inputFiles())
        raise Done
    monkeypatch.setattr(catalog.sp, "stratified_split", split)
    day = datetime.datetime(2026, 1, 1)
    spark.createDataFrame([(i, i, i, 1, 2.0, 10.0 * i, 0.1, 0.0, "RA"[i % 2], "O", day) for i in range(20)], """
        l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double,
        l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp""") \
        .write.parquet(str(tmp_path / "lineitem.parquet"))
    with pytest.raises(Done):
        catalog.m7_train_gbt(spark, str(tmp_path))
    assert seen and not any("lineitem" in f for f in seen)
