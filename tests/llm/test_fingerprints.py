import hashlib

from pyspark.sql import functions as F

from flowlens.llm import fingerprints as fp

from .conftest import ODD


def edits(rows):
    """The edited texts, by the contract's words."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for i, (k, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        out[k] = t[:len(t) - half] + nxt[:half]
    return out


def test_edited_texts(spark, docs):
    rows = [(i * 7 % 101, f"line {i}\nother {i}é\nlast" * (i % 4)) for i in range(101)] + [(500, None), (900, "😀x")]
    got = {r.doc_id: r for r in fp.fingerprint_edits(docs(rows)).collect()}
    assert len(got) == len(rows)
    for k, text in edits(rows).items():
        assert got[k].edited_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert got[k].n_chars == len(dict(rows)[k] or "")
        assert 0 <= got[k].near_edited <= 1 and 0 <= got[k].near_next <= 1


def test_one_row_follows_itself(docs):
    r, = fp.fingerprint_edits(docs([(9, "abcd")])).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert r.near_next == 1


def test_odd_rows_and_empty_table(odd, docs):
    assert fp.fingerprint_edits(odd).count() == len(ODD)
    assert fp.fingerprint_edits(docs([])).count() == 0


def test_order_of_paragraphs_does_not_matter_and_content_does(spark):
    rows = spark.createDataFrame([("a\nb\nb\nc",), ("c\nb\na\nb",), ("a\nb\nc",), ("a\nb\nb\nd",)], "t string")
    a, b, c, d = [r[0] for r in rows.select(fp.as_text(fp.fingerprint(F.col("t")))).collect()]
    assert a == b and a != c and a != d


def test_insertion_and_deletion(spark):
    row = spark.createDataFrame([("a\nb\nc", "a\nc", "b")], "whole string, rest string, part string")
    v = {c: fp.fingerprint(F.col(c)) for c in row.columns}
    got = row.select(fp.combine(v["rest"], v["part"]) == v["whole"], fp.remove(v["whole"], v["part"]) == v["rest"]).first()
    assert got[0] and got[1]


def test_likeness_follows_the_common_share(spark):
    lines = [f"paragraph {i}" for i in range(200)]
    rows = spark.createDataFrame([("\n".join(lines), "\n".join(lines[:k] + [f"new {i}" for i in range(200 - k)]))
                                  for k in (200, 150, 50, 0)], "a string, b string")
    got = [r[0] for r in rows.select(fp.likeness(fp.fingerprint(F.col("a")), fp.fingerprint(F.col("b")))).collect()]
    assert got[0] == 1 and abs(got[1] - 0.75) < 0.2 and abs(got[2] - 0.25) < 0.3 and got[3] < 0.3
