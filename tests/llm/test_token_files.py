import os

from pyspark.sql import functions as F

from flowlens.llm.token_store import read_store, store_index


def test_starts_follow_part_numbers_of_six_digits(spark, tmp_path):
    """Files 99999 and 100000, as a job of more than 100,000 partitions has them."""
    rows = [(1, [5, 2]), (2, [6, 7, 2]), (3, [2])]
    for k, (doc, ids) in zip((99_999, 100_000, 100_001), rows):
        df = spark.createDataFrame([(doc, len(ids), ids)], "doc_id long, n_tokens long, ids array<int>")
        df.coalesce(1).write.parquet(str(tmp_path / f"w{k}"))
        name, = (f for f in os.listdir(tmp_path / f"w{k}") if f.endswith(".parquet"))
        os.makedirs(tmp_path / "store", exist_ok=True)
        os.rename(tmp_path / f"w{k}" / name, tmp_path / "store" / name.replace("part-00000", f"part-{k:05d}"))
    index = store_index(spark, str(tmp_path / "store")).orderBy("doc_id").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in index] == [(1, 0, 2), (2, 2, 3), (3, 5, 1)]
    assert read_store(spark, str(tmp_path / "store")).agg(F.sum("n_tokens")).first()[0] == 6
