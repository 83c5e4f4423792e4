import random

from inkgraph.operators.components import connected_components


def brute(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def test_components_against_union_find(spark):
    rng = random.Random(8)
    chain = [(k, k + 1) for k in range(100, 130)]
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + chain + [(200, 200), (None, 3), (0, 1), (1, 0)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == brute(edges)
    assert connected_components(spark.createDataFrame([], "src string, dst string")).count() == 0
