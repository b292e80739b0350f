"""SMOTE: what is written, and neighbours at equal distances."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from flowlens.operators import oversample as ov


def test_only_rows_of_the_classes_to_fill_are_written(spark, monkeypatch):
    df = spark.range(400).select(F.when(F.col("id") < 20, F.lit("rare")).otherwise(F.lit("common")).alias("label"), "id",
                                 F.col("id").cast("double").alias("a"))
    written, write = {}, ov.Scratch.write

    def count(self, frame, stage, **options):
        out = write(self, frame, stage, **options)
        written[stage] = out.count()
        return out

    monkeypatch.setattr(ov.Scratch, "write", count)
    out = ov.smote(df, "label", ["id"], ["a"], target_ratio=0.2, k=3)
    assert out.count() == int(0.2 * 380) - 20
    assert written["rows"] == 20


def test_ties_go_to_the_smallest_digest_and_no_digest_is_compared_with_all():
    n, k = 40, 4
    rng = np.random.default_rng(2)
    members = pd.DataFrame({"pid": [f"p{i:02d}" for i in rng.permutation(n)],
                            "x": [np.array([float(i % 5)]) for i in range(n)]})
    got = ov._visit(k, 1)(pd.concat([members.head(30), pd.DataFrame({"pid": ["other"], "x": [np.array([1.5])]})]), members)
    at = {p: x[0] for p, x in zip(members["pid"], members["x"])}
    for pid, d2, near in got.itertuples(index=False):
        x = at.get(pid, 1.5)
        want = sorted(((x - y) ** 2, p) for p, y in at.items() if p != pid)[:k]
        assert list(zip(d2, near)) == want
    few = ov._visit(k, 1)(members.head(2), members.head(2))
    assert [len(v) for v in few["near"]] == [1, 1]
