from pyspark.sql import functions as F

from flowlens.operators import score as sc


def test_probability_to_action(spark):
    df = spark.createDataFrame([(0.2121,), (0.6161,), (0.6162,), (None,)], "p double")
    out = sc.decide(df, "p", float32=False).select("risk_score", "action", "intent_class").collect()
    assert [tuple(r) for r in out] == [(20, "ALLOW", "BENIGN"), (60, "CHALLENGE", "BENIGN"),
                                       (61, "BLOCK", "MALICIOUS"), (50, "CHALLENGE", "UNKNOWN")]


def test_app_class_argmax_and_unknown(spark):
    df = spark.createDataFrame([([0.1, 0.7, 0.2],), ([0.1] * 8 + [0.9],), (None,)], "p array<double>")
    a = sc.app_class(F.col("p"))
    got = [tuple(r) for r in df.select(a["app_class"], a["app_confidence"]).collect()]
    assert got[0] == ("CHAT", 0.7) and got[1][0] == "UNKNOWN" and got[2] == ("UNKNOWN", 0.0)


def test_feature_vector_fallbacks(spark):
    df = spark.createDataFrame([({"a": 1.5},)], "m map<string,double>")
    v = df.select(sc.feature_vector(F.col("m"), ["a", "Protocol", "b"], protocol=F.lit("tcp"))).first()[0]
    assert v == [1.5, 6.0, 0.0]


def test_apply_model_failure_becomes_error_result(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([3.0, 4.0],)], "v array<float>")

    def bad(m):
        raise RuntimeError("model down")
    out = sc.decide(sc.apply_model(df, "v", bad), "p").select("risk_score").collect()
    assert [r[0] for r in out] == [50, 50]
    good = sc.apply_model(df, "v", lambda m: m.sum(axis=1) / 10.0).select("p").collect()
    assert [round(r[0], 6) for r in good] == [0.3, 0.7]


def test_a_bad_row_fails_alone(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "i int, v array<float>").coalesce(1)

    def picky(m):
        if (m[:, 0] == 4).any():
            raise ValueError("no four")
        return m[:, 0] / 10.0
    got = {r.i: (r.p, r.p_error) for r in sc.apply_model(df, "v", picky).collect()}
    assert got.pop(4) == (None, "ValueError: no four")
    assert all(e is None and abs(p - i / 10) < 1e-6 for i, (p, e) in got.items()) and len(got) == 8
