import random

from inkgraph.operators import graph, layout
from inkgraph.operators.ranks import ranked


def table(spark, n=3000):
    rng = random.Random(4)
    ids = rng.sample(range(10 * n), n)
    # one layer holds nearly all vertices
    return spark.createDataFrame([(v, 2 if k % 10 else k % 7) for k, v in enumerate(ids)] + [(-1, None)], "v long, layer int").repartition(5)


def places(rows):
    found, count = {}, {}
    for layer, v in sorted((r.layer, r.v) for r in rows if r.layer is not None):
        found[v] = count.get(layer, 0)
        count[layer] = found[v] + 1
    return found, count


def test_places_in_one_large_layer(spark):
    layers = table(spark)
    want, count = places(layers.collect())
    out = ranked(layers.where("layer IS NOT NULL"), "layer", ["v"], "level")
    assert out.columns == ["v", "layer", "level"]
    rows = out.collect()
    assert len(rows) == 3000 and {r.v: r.level for r in rows} == want
    assert {r.v: r.level for r in layout.place(layers).collect()} == want
    for r in layout.place_centred(layers.where("v % 3 = 0 OR layer <> 2"), 250, 130).collect():
        assert r.v != -1 and r.x % 250 == 0
    at = {r.v: r.position for r in graph.topological_order(layers).collect()}
    layer_of = {r.v: r.layer for r in layers.collect()}
    assert sorted(at, key=at.get) == sorted(want, key=lambda v: (layer_of[v], v))
    assert sorted(at.values()) == list(range(3000)) and sum(count.values()) == 3000


def test_null_groups_repeated_rows_and_no_rows(spark):
    rows = spark.createDataFrame([(None, 2), (None, 1), (1, 5), (1, 5), (1, None)], "g int, v int")
    got = sorted(((r.g is not None, r.place) for r in ranked(rows, "g", ["v"], "place").collect()))
    assert got == [(False, 0), (False, 1), (True, 0), (True, 1), (True, 2)]
    assert ranked(rows.where("v > 9"), "g", ["v"], "place").count() == 0


def swept(edges, layers, sweeps=3):
    """Sweeps left to right and back, one layer after the other, by the places at the start."""
    start = {}
    for v in sorted(layers):
        start.setdefault(layers[v], []).append(v)
    now = {k: list(vs) for k, vs in start.items()}
    for _ in range(sweeps):
        for k in [*sorted(now), *sorted(now, reverse=True)]:
            def score(v):
                near = [start[layers[a]].index(a) for a, b in edges if b == v and layers.get(a, k) < k] + [start[layers[b]].index(b) for a, b in edges if a == v and layers.get(b, k) > k]
                return sum(near) / len(near) if near else len(now[k]) / 2
            if len(now[k]) > 1:
                now[k] = sorted(now[k], key=score)
    return {(v, k, i) for k, vs in now.items() for i, v in enumerate(vs)}


def test_barycentres_are_those_of_the_sweeps(spark):
    rng = random.Random(11)
    layers = {f"v{i:02}": rng.randrange(5) for i in range(40)}
    edges = {(rng.choice(sorted(layers)), rng.choice(sorted(layers))) for _ in range(70)} | {("v00", "gone"), ("gone", "v01")}
    df = spark.createDataFrame([*edges, *list(edges)[:5]], "src string, dst string")
    rows = spark.createDataFrame([*layers.items(), ("gone", None)], "v string, layer int")
    assert {tuple(r) for r in layout.barycentre(df, rows).select("v", "layer", "level").collect()} == swept(edges, layers)
    assert layout.barycentre(df.limit(0), rows.limit(0)).isEmpty()
