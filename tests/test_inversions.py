import random

import numpy as np

from inkgraph.operators.inversions import inversions, opposite_pairs


def test_inversions_of_groups():
    rng = np.random.default_rng(2)
    values, weights = rng.integers(0, 300, 400), rng.integers(1, 9, 400)
    begins = np.array([0, 1, 150, 399])
    want = []
    for a, b in zip(begins, [*begins[1:], 400]):
        want.append([(sum(values[j] > values[k] for k in range(a, b) for j in range(a, k))), sum(weights[j] * weights[k] for k in range(a, b) for j in range(a, k) if values[j] > values[k])])
    assert [list(x) for x in zip(inversions(begins, values), inversions(begins, values, weights))] == want
    assert list(inversions(np.array([], int), np.array([], int))) == []


def test_pairs_in_many_parts(spark):
    rng = random.Random(5)
    # a group of many rows with one p, one with one q, repeated rows, negative and large numbers, nulls
    rows = [(1, rng.choice([7, rng.randrange(-40, 40)]), rng.randrange(1 << 40)) for _ in range(300)] + [(2, rng.randrange(90), rng.choice([3, rng.randrange(20)])) for _ in range(300)]
    rows += rows[:40] + [(3, 1, 1), (3, 1, 2), (3, 2, 2)] + [(4, None, 1), (None, 1, 2), (1, 1, None)]
    known = [r for r in rows if None not in r]
    want = {}
    for k, (g, p, q) in enumerate(known):
        want[g] = want.get(g, 0) + sum((p - r[1]) * (q - r[2]) < 0 for r in known[:k] if r[0] == g)
    got = opposite_pairs(spark.createDataFrame(rows, "g int, p long, q long"), ["g"], "p", "q", part=20)
    assert {r.g: r.n for r in got.collect()} == {g: n for g, n in want.items() if n}
    assert opposite_pairs(spark.createDataFrame([], "g int, p long, q long"), ["g"], "p", "q").collect() == []


def test_no_task_sorts_all_edges_of_two_layers(spark):
    """Windows over the edges of two layers would put them all in one task."""
    from inkgraph.operators import layout

    placed = spark.createDataFrame([(f"{layer}-{k}", layer, k) for layer in (0, 1) for k in range(9)], "v string, layer int, level int")
    edges = spark.createDataFrame([(f"0-{k}", f"1-{8 - k}") for k in range(9)], "src string, dst string")
    found = layout.crossings(edges, placed)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [(0, 1, 36)] and [f.dataType.simpleString() for f in found.schema] == ["int", "int", "bigint"]
