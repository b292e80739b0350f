import random

from flowlens.llm.components import components
from flowlens.session import Scratch


def test_components_of_chains_stars_and_cliques(spark):
    rnd = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 201), (201, 200), (300, 300)]
    links += [(rnd.randrange(400, 480), rnd.randrange(400, 480)) for _ in range(70)]
    rnd.shuffle(links)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in links:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    scratch = Scratch(spark, "t")
    got = dict(map(tuple, components(spark.createDataFrame(links, "u long, v long"), scratch, "c").collect()))
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components(spark.createDataFrame([], "u long, v long"), scratch, "d").count() == 0
