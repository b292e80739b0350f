import collections
import re

import pytest

from flowlens.llm import phrase_rollup as pr

from .conftest import ODD

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, least=30, top=2000):
    """(lang, text) rows -> the phrases, by counting every phrase of every length."""
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(FOLD)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    f = {k: v for k, v in f.items() if v >= least}
    found = collections.defaultdict(list)
    for (lang, p), a in f.items():
        longer = [v for (g, q), v in f.items() if g == lang and len(q) > len(p)
                  and any(q[i:i + len(p)] == p for i in range(len(q)))]
        if len(p) == 1 or any(100 * v >= 80 * a for v in longer):
            continue
        cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        found[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s)
            for lang, rows in found.items() for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top])]


def check(spark, rows, **options):
    df = spark.createDataFrame(rows, "lang string, text string")
    got = pr.collocations(df, **options)
    assert got.columns == COLUMNS
    got = sorted(map(tuple, got.collect()))
    assert got == sorted(brute(rows, options.get("least", 30), options.get("top", 2000)))
    return got


TEXTS = [("en", "New York City hall, New York City park; new york"), ("en", "the same words. the same words the same"),
         ("de", "der gute Hund\tder gute Hund! der Hund"), (None, "a b a b a b a b"), ("und", "b a b a"),
         ("en", "of the city of the city of The CITY"), ("en", "é É ü: x\x0by\x0cz\rx y z"), ("", "a b a b")]


@pytest.mark.parametrize("bits", [4, 20])
def test_against_counting_every_phrase(spark, bits):
    """Also where all counters are shared by many words."""
    rows = [t for i, t in enumerate(TEXTS * 20) if i % 3 or i < 60]
    for least in (5, 30):
        assert check(spark, rows, least=least, bits=bits)


def test_ties_and_top(spark):
    rows = [("en", "one two, three four, five six, seven eight")] * 30
    assert [r[2] for r in check(spark, rows, top=3)] == ["five six", "one two", "seven eight"]


def test_overlaps_longer_phrases_and_threshold(spark):
    rows = [("en", "x x x x x x")] * 10 + [("en", "p q r s t")] * 30 + [("en", "p q")] * 8 + [("en", "y z")] * 29
    got = {r[2] for r in check(spark, rows)}
    assert "p q" in got and "q r" not in got and "y z" not in got


def test_small_table_files_equal_large(spark):
    """More than one block, and blocks of several tasks."""
    rows = [("en", f"word{i % 7} and word{i % 5} of it") for i in range(400)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    assert sorted(map(tuple, pr.collocations(df, bits=17).collect())) == sorted(brute(rows))


def test_odd_rows(docs, spark):
    rows = [(None, t) for _, t in ODD] + [("en", None)]
    extra = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 AS f", "2 AS w1", "3 AS n", "4 AS phrase")
    got = pr.collocations(extra, least=2)
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows, 2))
    assert pr.collocations(docs([])).count() == 0
    assert pr.collocations(docs(ODD)).where("phrase = 'x x x x'").first().a == 30_000 - 3


def test_scores_past_64_bits(spark):
    """The products are decimals, the quotient is exact."""
    a, l, r = 9_000_000_000_000_000_000, 9_100_000_000_000_000_000, 9_200_000_000_000_000_000
    got = spark.sql(f"SELECT (cast({a}L as decimal(28,0)) * 2000000) div "
                    f"(cast({l}L as decimal(20,0)) + cast({r}L as decimal(20,0))) AS s").first().s
    assert got == 2_000_000 * a // (l + r)
