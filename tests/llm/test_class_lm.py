import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from flowlens.llm import class_lm as lm
from flowlens.llm.text import utf8, words

from .conftest import ODD, SF

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(FOLD)) + ["</s>"]


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 7 == 2


def test_base_scores_equal_a_plain_count(spark, docs):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows = table.collect()
    counts = collections.Counter()
    for r in rows:
        if not held(r.doc_id):
            counts.update(tokens(r.text))
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in lm.class_lm_scores(table).collect()}
    assert len(got) == len(rows)
    better = 0.0
    for r in rows:
        t, g = tokens(r.text), got[r.doc_id]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t)
        assert (g.n_tokens, g.n_known, g.train_tokens, g.held_out) == (len(t), sum(counts[w] > 0 for w in t), n, held(r.doc_id))
        assert math.isclose(base, g.base_score, rel_tol=1e-9)
        assert g.score < 0
        if g.held_out:
            better += g.score - g.base_score
    assert better > 0  # classes tell more than single words


def test_odd_rows_and_empty_table(odd, docs):
    got = lm.class_lm_scores(odd).collect()
    assert len(got) == len(ODD)
    twins = [r for r in got if r.doc_id == 4]
    assert len(twins) == 2 and twins[0] == twins[1] and twins[0].n_tokens == 2
    assert lm.class_lm_scores(docs([])).count() == 0


def test_repeated_rows_and_rare_words(docs, monkeypatch):
    monkeypatch.setattr(lm, "TABLE", 2)
    monkeypatch.setattr(lm, "VOCABULARY", 2)
    one, two = [i for i in range(9) if not held(i)][:2]
    rows = [(one, "a a a b c d")] * 3 + [(two, "a b c")]
    plain = collections.Counter()
    for k, t in rows:
        plain.update(tokens(t))
    n, v = sum(plain.values()), len(plain)
    for r in lm.class_lm_scores(docs(rows)).collect():
        text = "a a a b c d" if r.doc_id == one else "a b c"
        assert r.n_known == len(tokens(text))
        assert math.isclose(r.base_score, sum(math.log10((plain[w] + 1) / (n + v + 1)) for w in tokens(text)), rel_tol=1e-9)


def test_exchange_raises_the_class_likelihood():
    rnd = np.random.default_rng(0)
    kind = rnd.integers(0, 4, 40)
    counts = np.zeros((42, 42))
    for a in range(40):
        for b in range(40):
            counts[a, b] = rnd.poisson(30 if (kind[a] + 1) % 4 == kind[b] else 0.2)
    of = lm.exchange(counts, 40, classes=4, tail=2, sweeps=10)
    for k in range(4):  # words of a kind end up together
        assert len(set(of[:40][kind == k])) == 1


def test_probabilities_of_next_words_sum_to_one_at_most(docs, monkeypatch):
    rows = [(i, "a b a b c") for i in range(6) if not held(i)]
    scores = {w: 10 ** next(r.score for r in lm.class_lm_scores(docs([*rows, (1000, w)])).collect() if r.doc_id == 1000)
              for w in ("a", "b", "c")} if held(1000) else {}
    assert sum(scores.values()) <= 1


def plain_scores(rows, model):
    """Scores by their definition, from the classes of the words alone."""
    hashes = {}

    def of(word):
        if word not in hashes:
            hashes[word] = lm.END if word == "</s>" else words(*utf8(pa.array([word]))).hash[0]
        return int(model.classes(np.array([hashes[word]]))[0])

    counts, tokens_in, words_in, pairs, before = (collections.Counter() for _ in range(5))
    for k, text in rows:
        if not held(k):
            counts.update(tokens(text))
            line = [of(w) for w in ["</s>", *tokens(text)]]
            pairs.update(zip(line[:-1], line[1:]))
            before.update(line[:-1])
    for w, c in counts.items():
        tokens_in[of(w)] += c
        words_in[of(w)] += 1
    classes = lm.CLASSES + lm.TAIL

    def score(text):
        line = ["</s>", *tokens(text)]
        return sum(math.log10((pairs[of(a), of(b)] + 1) / (before[of(a)] + classes))
                   + math.log10((counts[b] + 1) / (tokens_in[of(b)] + words_in[of(b)] + 1)) for a, b in zip(line, line[1:]))
    return score


def _texts(table):
    return table.select("doc_id", "text", F.xxhash64("text").alias("hash"), lm.in_training(F.col("doc_id")).alias("train"))


def test_scores_equal_plain_ones_over_the_classes(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    texts = _texts(table)
    model = lm.fit(texts, lm.word_counts(texts))
    rows = [(r.doc_id, r.text) for r in table.collect()]
    score = plain_scores(rows, model)
    got = {r.doc_id: r.score for r in lm.class_lm_scores(table).collect()}
    for k, text in rows:
        assert math.isclose(score(text), got[k], rel_tol=1e-9)


def test_every_word_seen_twice_has_a_class(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    texts = _texts(table)
    counts = lm.word_counts(texts)
    model = lm.fit(texts, counts)
    seen = counts.toPandas()
    k = model.classes(seen["w"].to_numpy(np.int64).view(np.uint64))
    assert (k[seen["c"] >= lm.LEAST] < lm.CLASSES).all() and (seen["c"] >= lm.LEAST).sum() > lm.VOCABULARY
    assert len(set(k[seen["c"] >= lm.LEAST].tolist())) > lm.CLASSES // 2


def test_words_of_a_kind_meet_without_being_frequent(docs, monkeypatch):
    """Two seeds; the other words are moved by the Spark sweeps alone."""
    monkeypatch.setattr(lm, "VOCABULARY", 3)
    rnd = np.random.default_rng(1)
    one, two = [f"a{i}" for i in range(8)], [f"b{i}" for i in range(8)]
    rows = [(i, " ".join(w for _ in range(20) for w in ("x", rnd.choice(one), "y", rnd.choice(two))))
            for i in range(40) if not held(i)]
    texts = _texts(docs(rows))
    model = lm.fit(texts, lm.word_counts(texts))

    def classes(kind):
        return set(model.classes(np.array([words(*utf8(pa.array([w]))).hash[0] for w in kind])).tolist())
    assert len(classes(one)) == len(classes(two)) == 1 and classes(one) != classes(two)


def test_gains_equal_the_difference_of_whole_tables():
    rnd = np.random.default_rng(2)
    total = lm.CLASSES + lm.TAIL
    table = rnd.integers(5, 90, (total, total)).astype(float)
    before, after = (rnd.multinomial(4, np.ones(total) / total, 6) for _ in range(2))
    old = np.array([0, 3, lm.CLASSES, lm.CLASSES, 7, 47])

    def value(t):
        return lm.nlogn(t).sum() - lm.nlogn(t.sum(0)).sum() - lm.nlogn(t.sum(1)).sum()
    for i, new in enumerate(lm.best_classes(before, after, table, old).tolist()):
        without = table.copy()
        if old[i] < lm.CLASSES:
            without[:, old[i]] -= before[i]
            without[old[i]] -= after[i]
        reached = []
        for k in range(lm.CLASSES):
            t = without.copy()
            t[:, k] += before[i]
            t[k] += after[i]
            reached.append(value(t))
        assert reached[new] > max(reached) - 3  # cells (k, k), and margins of neighbours, are taken as they were
