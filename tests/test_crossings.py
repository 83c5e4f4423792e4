import random

from inkgraph.operators import layout


def test_crossings_of_levels_of_any_size(spark):
    rng = random.Random(4)
    levels = [0, 1, 7, 15, 16, 17, 255, 256, 4096, 70_000, 1 << 33, (1 << 40) + 3]
    placed = [(f"{layer}-{k}", layer, level) for layer in (0, 1) for k, level in enumerate(levels)]
    level = {v: n for v, _, n in placed}
    edges = [(f"0-{rng.randrange(12)}", f"1-{rng.randrange(12)}") for _ in range(80)]
    want = sum((level[a] - level[c]) * (level[b] - level[d]) < 0 for k, (a, b) in enumerate(edges) for c, d in edges[:k])
    got = layout.crossings(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(placed, "v string, layer int, level long")).collect()
    assert [tuple(r) for r in got] == [(0, 1, want)]
