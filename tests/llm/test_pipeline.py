import collections
import hashlib

from tokenizers import Tokenizer

import corpus_pipeline as cp
from flowlens.llm import pii
from flowlens.llm.queries import vocabulary

from .test_jaccard_rtree import brute

SF = "/root/testdata/sf0.001"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_stages_against_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, last = docs.columns, None
    for k, (name, stage) in enumerate(cp.STAGES):
        before = docs.collect()
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = docs.collect()
        if k < len(cp.STAGES) - 1:
            assert docs.columns == columns
        ids = {r.doc_id for r in after}
        if name == "quality classifier":
            assert 0 < len(after) < len(before)
            assert set(map(tuple, after)) <= set(map(tuple, before))
        elif name == "exact dedup":
            keep = {}
            for r in before:
                key = hashlib.sha256((r.text or "").translate(FOLD).encode()).digest()
                keep[key] = max(keep.get(key, -1), r.doc_id)
            assert ids == set(keep.values())
        elif name == "n-gram Jaccard join":
            groups = brute([(r.doc_id, r.text) for r in before])
            assert ids == {c for (_, _, c) in groups}
        elif name == "PII":
            texts = {r.doc_id: r.text for r in before}
            assert {r.doc_id: r.text for r in after} == {k: pii.redacted(t) for k, t in texts.items()}
            assert all(not [s for s in pii.spans(r.text) if s[0] in pii.BASE] for r in after)
        else:
            total = collections.Counter()
            for r in after:
                total[r.doc_id] += r.n_tokens
            of = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
            assert total == {r.doc_id: len(of.encode(r.text, add_special_tokens=False).ids) + 1 for r in before}
        last = after
    assert sorted(map(tuple, cp.run(spark, SF).collect())) == sorted(map(tuple, last))


def test_stages_on_odd_rows_with_clashing_columns(spark, odd):
    docs = odd.selectExpr("*", "1 AS statistics", "2 AS kept_id", "'x' AS id", "3 AS component_id", "4 AS kept")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        out.count()
    cp.packing(spark, docs, SF).count()
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def _plain_exact(rows):
    best = {}
    for k, t in rows:
        key = (t or "").translate(FOLD)
        if key not in best or (best[key][0] is None and k is not None) or (None not in (k, best[key][0]) and k > best[key][0]):
            best[key] = (k, t)
    return collections.Counter((k, (t or "").translate(FOLD)) for k, t in best.values())


def _plain_near(rows):
    """Rows by number, linked by their sets; the smallest id of each component."""
    from .test_jaccard_rtree import brute
    parts = collections.defaultdict(list)
    for i, _, c in brute([(i, t) for i, (_, t) in enumerate(rows)]):
        parts[c].append(rows[i])
    return collections.Counter(min((k is None, -1 if k is None else k) for k, _ in group) for group in parts.values())


def test_dedup_keeps_rows_not_ids(spark, docs, tmp_path):
    """Ids that repeat over different texts, rows that repeat, null ids; from
    files and from memory."""
    long = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"
    rows = [(5, "alpha beta"), (5, "alpha beta"), (7, "gamma delta"), (9, "gamma delta"), (7, "other words"),
            (1, long), (3, long + " more"), (3, "another text"), (None, long.upper()), (None, "x y"), (None, "X y"),
            (None, None), (2, ""), (4, "far off"), (4, "far off"), (4, "FAR off now")]
    df = docs(rows)
    df.repartition(3).write.parquet(str(tmp_path / "d"))
    for source in (df, spark.read.parquet(str(tmp_path / "d"))):
        got = cp.exact_dedup(spark, source, SF)
        assert collections.Counter((r.doc_id, (r.text or "").translate(FOLD)) for r in got.collect()) == _plain_exact(rows)
        near = [(r.doc_id is None, -1 if r.doc_id is None else r.doc_id) for r in cp.near_dedup(spark, source, SF).collect()]
        assert collections.Counter(near) == _plain_near(rows)


def test_exact_dedup_of_a_hot_text(spark, docs):
    rows = [(i % 50, "HOT text" if i % 3 else "hot text") for i in range(400)] + [(i, f"t {i % 9}") for i in range(60)]
    got = cp.exact_dedup(spark, docs(rows), SF)
    assert collections.Counter((r.doc_id, r.text.translate(FOLD)) for r in got.collect()) == _plain_exact(rows)
