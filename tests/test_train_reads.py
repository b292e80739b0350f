"""M7: what the boosting rounds read and keep."""
from pyspark.sql import functions as F

from flowlens.operators import train as tr


def test_trees_are_trained_without_node_ids_kept_for_every_row(spark):
    df = spark.range(0, 200).select((F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 2 * 10 + F.col("id") % 7).cast("double").alias("a"))
    model = tr.train_gbt(df, ["a"], "y", max_iter=2, max_depth=2)
    assert not model.getOrDefault(model.cacheNodeIds)
    assert tr.probability(model, df, ["a"]).where("(p >= 0.5) <> (y = 1)").count() == 0


def test_flows_are_deduplicated_once_for_training(spark, monkeypatch):
    from flowlens.plans import catalog
    seen = []

    class Done(Exception):
        pass

    def train(rows, *_args, **_options):
        seen.extend(rows.inputFiles())
        raise Done

    monkeypatch.setattr(catalog.tr, "train_gbt", train)
    try:
        catalog.m7_train_gbt(spark, "/root/testdata/sf0.001")
    except Done:
        pass
    assert seen and not any("lineitem" in f for f in seen)
