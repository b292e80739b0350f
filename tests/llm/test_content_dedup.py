import collections
import hashlib

from flowlens.llm.content_dedup import content_duplicates

from .conftest import ODD

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def check(df, rows, keep="largest"):
    norm = [(k, (t or "").translate(FOLD)) for k, t in rows]
    groups = collections.defaultdict(list)
    for k, t in norm:
        groups[t].append(k)
    got = content_duplicates(df, keep=keep).collect()
    assert len(got) == len(rows)
    pick = max if keep == "largest" else min
    want = collections.Counter()
    for k, t in norm:
        ids = [x for x in groups[t] if x is not None]
        want[k, pick(ids) if ids else None, len(groups[t]), hashlib.sha256(t.encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = collections.Counter(r.text_sha256 for r in got if r.kept)
    assert all(n == 1 for n in kept.values()) and len(kept) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_groups_sizes_and_hot_texts(docs):
    rows = [(i, f"Text number {i % 37} É") for i in range(400)] + [(1000 + i, "HOT text") for i in range(300)]
    check(docs(rows), rows)
    check(docs(rows), rows, keep="smallest")


def test_odd_rows(odd):
    check(odd, ODD)


def test_only_a_to_z_fold(docs):
    rows = [(1, "É"), (2, "é"), (3, "A"), (4, "a")]
    check(docs(rows), rows)


def test_hot_repeated_rows_with_null_ids(docs):
    rows = [(None, "x")] * 40 + [(7, "y")] * 40 + [(None, "y")] * 9
    check(docs(rows), rows)


def test_empty_and_clashing_columns(docs):
    assert content_duplicates(docs([])).count() == 0
    clash = docs([(1, "a"), (2, "A")]).selectExpr("*", "1 AS body", "2 AS kept", "3 AS id", "4 AS part")
    assert {r.keep_id for r in content_duplicates(clash).collect()} == {2}


def test_no_python_in_the_plan(spark, docs):
    plan = content_duplicates(docs([(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
