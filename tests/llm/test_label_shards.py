import collections
import zlib

import pytest
from pyspark.sql import functions as F

from flowlens.llm import label_shards as ls
from flowlens.session import Scratch

from .conftest import ODD


def check(df, rows, **options):
    """The law, the slots and the values of every row; returns {text: rows in each shard}."""
    got = ls.balanced_shards(df, **options).collect()
    shards = options.get("shards", ls.SHARDS)
    want = collections.Counter((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in rows)
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    assert all(r.law == "rows" and r.grown_shard is None for r in got)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    sizes = [len(slots[s]) for s in range(shards)]
    assert set(slots) <= set(range(shards)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    out = collections.defaultdict(collections.Counter)
    for r in got:
        out[r.text_crc32][r.shard] += 1
    return {t or "": out[zlib.crc32((t or "").encode())] for _, t in rows}


def cut(placed):
    return sum((sum(c.values()) ** 2 - sum(v * v for v in c.values())) // 2 for c in placed.values())


def test_groups_that_fit_stay_whole(docs):
    rows = [(i, f"group {i % 40}") for i in range(200)] + [(1000 + i, f"alone {i}") for i in range(150)]
    assert cut(check(docs(rows), rows)) == 0


def test_all_linked_without_room(docs):
    """Pairs that fill the shards: rows can move in exchange only."""
    rows = [(i, f"pair {i // 2}") for i in range(64)]
    before = cut({t: collections.Counter(k % 8 for k, x in rows if x == t) for _, t in rows})
    assert before == 32
    assert cut(check(docs(rows), rows)) <= 4


def test_group_larger_than_a_shard(docs):
    """200 of 400 rows over shards of 50: four full shards cut least."""
    rows = [(i, "hot") for i in range(200)] + [(1000 + i, f"alone {i}") for i in range(200)]
    placed = check(docs(rows), rows)
    assert sorted(placed["hot"].values()) == [50] * 4


def test_hot_group_and_small_ones(docs):
    rows = [(i, "hot") for i in range(333)] + [(1000 + i, f"group {i // 3}") for i in range(330)] \
        + [(5000 + i, f"alone {i}") for i in range(340)]
    placed = check(docs(rows).repartition(7), rows)
    small = {t: c for t, c in placed.items() if t.startswith("group")}
    assert sum(len(c) == 1 for c in small.values()) >= 0.9 * len(small)
    assert len(placed["hot"]) <= 4


def test_all_rows_alike(docs):
    rows = [(7, "x")] * 83
    check(docs(rows), rows)
    rows = [(None, None)] * 21
    check(docs(rows), rows, shards=5)


def test_fewer_rows_than_shards(docs):
    rows = [(1, "a"), (2, "a"), (3, "b")]
    check(docs(rows), rows)


def test_odd_rows(odd, docs):
    check(odd, ODD)
    assert ls.balanced_shards(docs([])).count() == 0
    clash = odd.selectExpr("*", "1 AS row", "2 AS shard", "3 AS `group`", "4 AS size", "5 AS part")
    check(clash, ODD)


def test_large_group_in_pieces(docs, monkeypatch):
    monkeypatch.setattr(ls, "PART", 16)
    rows = [(i, "hot") for i in range(150)] + [(1000 + i, f"group {i % 30}") for i in range(90)]
    check(docs(rows), rows)


def test_other_groups(docs):
    rows = [(i, f"text {i}", f"source {i % 12}") for i in range(240)]
    got = ls.balanced_shards(docs(rows), group=F.col("source")).collect()
    where = collections.defaultdict(set)
    for r in got:
        where[r.doc_id % 12].add(r.shard)
    assert sum(len(s) for s in where.values()) < 12 * 4


def plain_round(blocks, shares, k):
    """One round over {(group, shard): rows}, by a walk through sorted proposals."""
    n = len(shares)
    room = [shares[s] - sum(v for (_, t), v in blocks.items() if t == s) for s in range(n)]
    allowed = set(range(n)) if k % 2 else {s for s in range(n) if room[s] > 0}
    asked = collections.defaultdict(list)
    for (g, s), v in blocks.items():
        near = [(w, t) for (h, t), w in blocks.items() if h == g and t in allowed]
        if near and max(near)[0] > v:
            asked[s, max(near)[1]].append((max(near)[0], g, v))
    quota = ls.quotas({k: sum(v for _, _, v in p) for k, p in asked.items()}, room)
    for (s, t), q in quota.items():
        for near, g, v in sorted(asked[s, t], key=lambda x: -x[0]):
            m = min(v, q)
            blocks[g, s] -= m
            blocks[g, t] += m
            q -= m
    return {k: v for k, v in blocks.items() if v}


def test_rounds_against_a_plain_version(spark, monkeypatch):
    """Groups whose sizes leave no ties, proposals of a size class in order."""
    monkeypatch.setattr(ls, "BUCKETS", 1)
    blocks = {(f"g{g}", s): (3 ** g * (s + 2) + 7 * s * s + g) % 97 + 100 * ((s + g) % 5) + 1
              for g in range(5) for s in range(5)}
    total = [sum(v for (_, t), v in blocks.items() if t == s) for s in range(5)]
    shares = [max(total) + 40] * 5
    df = spark.createDataFrame([(g, s, v) for (g, s), v in blocks.items()], "group string, shard int, rows long")
    for rounds in (1, 4):
        want = blocks
        for k in range(1, rounds + 1):
            want = plain_round(dict(want), shares, k)
        got = ls.propagate(df, shares, Scratch(spark, "test"), rounds)
        assert {(r["group"], r.shard): r["rows"] for r in got.collect()} == want


@pytest.mark.parametrize("room", [[0, 0, 0], [5, 0, 2], [100, 100, 100]])
def test_quotas(room):
    wanted = {(0, 1): 30, (1, 0): 10, (1, 2): 7, (2, 0): 50, (0, 2): 1}
    x = ls.quotas(wanted, room)
    for t in range(3):
        assert sum(v for k, v in x.items() if k[1] == t) <= sum(v for k, v in x.items() if k[0] == t) + room[t]
    assert all(0 < v <= wanted[k] for k, v in x.items())
    assert room[0] < 100 or x == wanted
    assert x


def test_no_python_in_the_plans(spark, docs):
    blocks = spark.createDataFrame([("a", 0, 1), ("a", 1, 3)], "group string, shard int, rows long")
    for df in (ls.balanced_shards(docs([(1, "a")])), ls._proposals(blocks, [0, 1], 1),
               ls._moved(ls._proposals(blocks, [0, 1], 1), {(0, 1): 1})):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan
