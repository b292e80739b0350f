import numpy as np
from pyspark.sql import functions as F

from flowlens.llm import queries
from flowlens.llm import rule_ensemble as re_
from flowlens.session import Scratch

from .conftest import ODD

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = queries.QUERIES["op7_quality_classifier"](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 40 and sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_column_equals_the_rules_in_numpy(spark):
    rnd = np.random.default_rng(1)
    x = rnd.random((600, len(re_.NAMES)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] <= 0.7)).astype(float)
    rules = re_.fit(x, y)
    rows = spark.createDataFrame([(i, tuple(map(float, r))) for i, r in enumerate(x)], "i int, s " + re_.STRUCT.simpleString())
    got = np.array([r[0] for r in rows.orderBy("i").select(rules.score("s")).collect()])
    total = rules.bias + sum(w * re_._holds(r, x) for r, w in zip(rules.rules, rules.weights))
    assert np.allclose(got, 1 / (1 + np.exp(-total)))
    assert ((got > 0.5) == (y > 0)).mean() > 0.97
    assert 0 < len(rules.rules) < 250  # most rules have no weight


def test_statistics_of_plain_texts():
    import pyarrow as pa
    got = re_._batch_statistics(pa.array(["ab AB 12!\nab ab\n", None, "", "é", "a b a b"]))
    s = dict(zip(re_.NAMES, got[0]))
    assert np.isclose(s["upper"], 2 / 16) and np.isclose(s["digits"], 2 / 16) and np.isclose(s["breaks"], 2 / 16)
    assert np.isclose(s["distinct_words"], 2 / 5) and np.isclose(s["upper_words"], 1 / 5)
    assert not got[1].any() and not got[2].any()
    assert dict(zip(re_.NAMES, got[3]))["bytes_high"] == 1
    assert np.isclose(dict(zip(re_.NAMES, got[4]))["repeated_pairs"], 1 / 3)


def test_labels_without_use(spark, odd, docs):
    labels = spark.createDataFrame([(1, None), (99, 1), (None, 0)], "doc_id long, quality int")
    rules, stats = re_.quality_model(odd, labels, Scratch(spark, "t"))
    got = [r[0] for r in stats.select(rules.score("stats")).collect()]
    assert len(got) == len(ODD) and all(abs(x - 0.5) < 1e-9 for x in got)
    rules, stats = re_.quality_model(docs([]), labels, Scratch(spark, "t"))
    assert stats.count() == 0


def test_extra_columns_with_clashing_names(docs):
    clash = docs([(1, "a b")]).selectExpr("*", "1 AS c0", "2 AS log_bytes").withColumn("score", F.lit(3))
    out = re_.with_statistics(clash, "text", "stats")
    assert out.columns == [*clash.columns, "stats"] and out.first()["c0"] == 1
