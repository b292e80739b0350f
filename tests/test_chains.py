"""Chained expiry: the next event after a deadline, against a plain search."""
import random

from pyspark.sql import functions as F

from flowlens.operators import chains as ch


def test_next_after_deadline_with_growing_frames_only(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(3), i, rng.randrange(400)) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, id long, t long")
    for strict in (False, True):
        out = ch.next_after_deadline(df, ["k"], "id", "t", F.col("t") + 30, strict=strict, bucket_width=50)
        # a frame from a row to the end of its partition is read again for every row of it
        assert "unboundedfollowing" not in out._jdf.queryExecution().analyzed().toString().lower()
        want = {}
        for k, i, t in rows:
            later = [(u, j) for l, j, u in rows if l == k and (u > t + 30 if strict else u >= t + 30)]
            want[i] = min(later)[1] if later else None
        assert {r.id: r.nxt for r in out.collect()} == want
