"""Histograms and mutual information of several columns in one pass."""
import math

from pyspark.sql import functions as F

from flowlens.operators import profile as pr
from flowlens.operators import train as tr


def _data(spark):
    return spark.createDataFrame([(float(i % 13), None if i % 7 == 0 else float(i), 4.0, math.nan if i % 5 == 0 else i / 3, i % 3)
                                  for i in range(200)], "a double, b double, const double, odd double, y int")


def test_histograms_equal_one_by_one(spark):
    df = _data(spark)
    specs = [("a", "clip", 9.0), ("b", "log10p1", None), ("const", None, None), ("odd", None, None)]
    got = sorted(map(tuple, pr.histograms(df, specs, bins=7).collect()))
    want = [tuple(r) for s in specs for r in pr.histogram(df, *s, bins=7).collect()]
    assert [(g[0], g[1], g[4]) for g in got] == [(w[0], w[1], w[4]) for w in sorted(want)]
    assert all(abs(g[2] - w[2]) < 1e-9 and abs(g[3] - w[3]) < 1e-9 for g, w in zip(got, sorted(want)))
    assert pr.histograms(df.where("a < 0"), specs).count() == 0


def test_mutual_informations_equal_one_by_one(spark):
    df = _data(spark).drop("odd").withColumn("z", F.col("y") * 2.0)
    got = {r.feature: r.mi for r in tr.mutual_informations(df, ["a", "b", "const", "z"], "y").collect()}
    for c, mi in got.items():
        assert abs(mi - tr.mutual_information(df, c, "y").first().mi) < 1e-9
    assert got["z"] > 1.0 and abs(got["const"]) < 1e-9


def test_two_scans_whatever_the_number_of_columns(spark, tmp_path):
    _data(spark).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = pr.histograms(df, [(c, None, None) for c in ("a", "b", "const")])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 2
