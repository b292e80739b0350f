import collections
import random
import re
import zlib

import numpy as np

from flowlens.llm import trie_pairs as tp

from .conftest import ODD, SF

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def counted(rows, least_size=6, least_n=5):
    n = collections.Counter()
    for k, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= least_size and c >= least_n}


def brute(n, times=5):
    near = {w: [u for u in n if one_apart(w, u)] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda u: (-n[u], u), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), None if form[w] is None else n[form[w]]))
    return sorted(out)


def check(df, rows, **options):
    got = tp.spelling_forms(df, **options)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = sorted(map(tuple, got.collect()))
    assert got == brute(counted(rows, options.get("least_size", 6), options.get("least_n", 5)))
    return got


def test_replaced_inserted_deleted_and_chains(docs):
    n = {"letter": 700, "leter": 4, "lettter": 100, "letters": 130, "lettxr": 20, "lettxs": 5, "lletter": 3, "aaaaaa": 90,
         "aaaaaaa": 8, "aaaaaaaa": 7, "straße": 60, "strasse": 61, "strase": 6, "étéété": 31, "eteete": 9, "eteeté": 30,
         "étéetà": 5, "winter": 25, "wintex": 5, "winten": 25, "wintel": 5}
    rows = [(i, " ".join([w.upper() if w.isascii() and i % 2 else w] * 2)) for w, c in n.items() for i in range(c)]
    got = {r[0]: r for r in check(docs(rows), rows, least_size=4)}
    assert got["leter"][1] == "letter"
    assert got["aaaaaaa"][4] == 2 and got["wintex"][1] == "winten"


def test_random_words_of_few_letters(docs):
    """Many neighbours, runs of equal letters, shared prefixes and suffixes."""
    rng = random.Random(5)
    pool = ["".join(rng.choices("abé", k=rng.randint(1, 7))) for _ in range(900)]
    rows = [(i, " ".join(rng.choices(pool, weights=[1 / (k + 1) for k in range(900)], k=60))) for i in range(300)]
    assert sum(r[4] for r in check(docs(rows), rows, least_size=1, least_n=2)) > 1000


def test_whole_words_around_the_byte_classes(docs):
    rows = [(i, "naïveté×÷ÀÿÀÿ don't x¿abcdefĀghijkl Ébcdef1ghijkl abcdef") for i in range(40)]
    check(docs(rows), rows)


def test_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(check(df, [(r.doc_id, r.text) for r in df.collect()])) > 100


def test_odd_rows(odd, docs):
    long = "ab" * 20_000
    rows = ODD + [(i % 3 or None, f"{long} {long}c word{'x' * (i % 2)}") for i in range(30)] + [(1, "wordword")] * 6
    check(docs(rows), rows)
    check(odd, ODD, least_size=1, least_n=1)
    assert tp.spelling_forms(docs([])).count() == 0
    clash = docs(rows).selectExpr("*", "1 AS id", "2 AS word", "3 AS n", "4 AS near")
    check(clash, rows)


def test_checksums_go_on():
    data = np.frombuffer("no thing longer".encode(), np.uint8)
    start, end = np.array([0, 3, 9, 2, 5]), np.array([2, 8, 15, 2, 5])
    state = np.array([zlib.crc32(x) for x in (b"1:", b"", b"77:", b"a", b"")], np.uint32)
    want = [zlib.crc32(data[s:e].tobytes(), int(c)) for s, e, c in zip(start, end, state)]
    assert tp.crc_from(state, data, start, end).tolist() == want
