import random

from ordlens.llm.graph import components


def test_components_of_paths_stars_and_noise(spark):
    r = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(205, 203), (203, 209), (209, 201)]
    edges += [(300 + r.randrange(80), 300 + r.randrange(80)) for _ in range(60)] + [(500, 500)]
    r.shuffle(edges)
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {n.node: n.label for n in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
