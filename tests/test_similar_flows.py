import random

from flowlens.operators import clean as cl


def alike(a, b):
    if a is None or b is None:
        return a is b
    return min(a, b) >= 0.95 * max(a, b)


def check(spark, rows):
    df = spark.createDataFrame(rows, "n long, k string, x double, y long")
    got = {r.n for r in cl.drop_similar(df, ["x", "y"], ["n"], key_cols=["k"]).collect()}
    assert got == {n for n, k, x, y in rows
                   if not any(m < n and j == k and alike(v, x) and alike(w, y) for m, j, v, w in rows)}


def test_flows_on_both_sides_of_a_border(spark):
    check(spark, [(1, "a", 965.0, 10), (2, "a", 966.0, 10), (3, "b", 965.0, 10), (4, "a", 966.0, 12)])


def test_equals_all_pairs(spark):
    rnd = random.Random(5)
    rows = [(n, rnd.choice(["a", "b", None]), rnd.choice([None, 0.0, rnd.uniform(0.1, 3), float(rnd.randint(90, 130))]),
             rnd.choice([None, 0, 19, 20, 361, 380, 400, rnd.randint(1, 40)])) for n in range(700)]
    check(spark, rows)
    check(spark, [(n, "a", 1.0, n % 200) for n in range(400)])
    assert cl.drop_similar(spark.createDataFrame([], "n long, k string, x double, y long"), ["x"], ["n"],
                           key_cols=["k"]).count() == 0
