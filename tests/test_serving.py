import numpy as np
import pytest
from pyspark.sql import functions as F

from inkgraph.operators import graph as operators
from inkgraph.operators import layout
from inkgraph.operators.serving import Store, morton, write_links, write_nodes, write_store
from inkgraph.plans.scratch import scratch


@pytest.fixture(scope="module")
def graph(spark):
    rng = np.random.default_rng(4)
    nodes = [(f"n{k}", int(rng.integers(0, 30)), int(rng.integers(0, 40))) for k in range(3000)]
    nodes = [(v, a, b, None if k % 50 == 0 else a * 240.0 - 900, None if k % 50 == 0 else b * 130.0 - 500) for k, (v, a, b) in enumerate(nodes)]
    edges = [(f"n{a}", f"n{b}") for a, b in rng.integers(0, 3000, (4000, 2))] + [("n7", f"n{b}") for b in range(300)] + [("n7", "n8")] * 3 + [(None, "n1"), ("n1", "lost"), ("n1", "lost2")]
    placed = spark.createDataFrame([*nodes, ("nowhere", None, None, None, None)], "v string, layer int, level int, x double, y double")
    links = spark.createDataFrame(edges, "src string, dst string")
    path = scratch(spark, "layout")
    write_store(placed, links, path, per_file=200)
    at = {v: (a, b, a * 240.0 if x is None else x, b * 130.0 if y is None else y) for v, a, b, x, y in nodes}
    return Store(spark, path), placed, links, at, {(a, b) for a, b in edges if a}


VIEWS = [(-1000, -600, 300, 400), (0, 0, 0, 0), (700, 100, 2000, 3000), (-1e9, -1e9, 1e9, 1e9), (1e7, 1e7, 2e7, 2e7)]


@pytest.mark.parametrize("view", VIEWS)
def test_viewport(graph, view):
    store, _, _, at, edges = graph
    seen = {v for v, (_, _, x, y) in at.items() if view[0] <= x <= view[2] and view[1] <= y <= view[3]}
    assert {r.v for r in store.nodes(*view).collect()} == seen
    want = set()
    for v in seen:
        want |= set(sorted(e for e in edges if e[0] == v)[:4]) | set(sorted(e for e in edges if e[1] == v)[:4])
    rows = [tuple(r) for r in store.links(*view, 4).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    blocks = {r.v: (r.layer, r.level, r.x, r.y, r.in_view) for r in store.blocks(*view, 4).collect()}
    ends = seen | {v for e in want for v in e}
    assert blocks == {v: (*at.get(v, (0, 0, 0.0, 0.0)), v in seen) for v in ends}


@pytest.mark.parametrize("page", [(0, 0, 0, 10), (500, 700, 20, 50), (-5000, 9000, 2990, 100), (100, 100, 5000, 10), (100, 100, 0, 0)])
def test_page(graph, page):
    store, _, _, at, edges = graph
    x, y, offset, limit = page
    order = sorted(at, key=lambda v: (round(((at[v][2] - x) ** 2 + (at[v][3] - y) ** 2) ** 0.5, 6), at[v][0], v))[offset : offset + limit]
    rows = store.page(*page).collect()
    assert [r.v for r in rows] == order and all(r.total == len(at) for r in rows)
    links = {e for e in edges if e[0] in order or e[1] in order}
    got = [tuple(r) for r in store.page_links(*page).collect()]
    assert len(got) == len(set(got)) and set(got) == links
    assert {(r.v, r.on_page) for r in store.page_blocks(*page).collect()} == {(v, v in order) for v in {*order, *(v for e in links for v in e if v in at)}}


def test_few_files_are_read(graph):
    store, placed, links, _, _ = graph
    files = {r.table: r.n for r in store.manifest.groupBy("table").count().withColumnRenamed("count", "n").collect()}
    assert files["nodes"] >= 12 and files["links_src"] >= 20
    assert len(store.nodes(0, 0, 200, 200).inputFiles()) <= 4
    assert len(store.page(500, 700, 0, 10).inputFiles()) < files["nodes"]
    assert len(store.links(0, 0, 200, 200).inputFiles()) <= 12
    assert "PushedFilters: [" in store.nodes(0, 0, 200, 200)._jdf.queryExecution().toString()
    plain = layout.viewport_nodes(placed, 0, 0, 900, 900)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, store.nodes(0, 0, 900, 900).collect()))


def test_key_takes_bits_in_turn(spark):
    far = spark.sql("SELECT 5.0D * 240 AS x, 3.0D * 130 AS y, 2147483647.0D * 240 AS far")
    row = far.select(morton(F.col("x"), F.col("y"), 0.0, 0.0), morton(F.col("far"), F.col("y"), 0.0, 0.0)).first()
    assert row[0] == 0b011011 and row[1] == sum(1 << 2 * k for k in range(31)) | 0b1010


def test_empty_store(spark):
    path = scratch(spark, "layout")
    write_store(spark.createDataFrame([], "v string, layer int, level int, x double, y double"), spark.createDataFrame([], "src string, dst string"), path)
    store = Store(spark, path)
    assert store.total() == 0 and store.page(0, 0, 0, 5).count() == 0 and store.blocks(0, 0, 9, 9).count() == 0 and store.page_blocks(0, 0, 0, 5).count() == 0


def test_pages_need_no_links(spark, graph):
    _, placed, links, at, _ = graph
    path = scratch(spark, "layout")
    write_nodes(placed, path, per_file=200)
    bare = Store(spark, path, links=False)
    assert bare.total() == len(at) and [r.v for r in bare.page(0, 0, 0, 10).collect()] == [r.v for r in graph[0].page(0, 0, 0, 10).collect()]
    write_links(links, path, per_file=200)
    whole = Store(spark, path)
    assert sorted(map(tuple, whole.links(0, 0, 2000, 900, 4).collect())) == sorted(map(tuple, graph[0].links(0, 0, 2000, 900, 4).collect()))


def test_layers_of_dealt_edges(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("a", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("y", "z"), ("q", "d")], "src string, dst string")
    want = {"a": 0, "b": 1, "c": 2, "d": 3, "q": 0, "x": None, "y": None, "z": None}
    kept = operators.dealt_edges(edges)
    assert kept.count() == 8 and "Exchange" not in kept.groupBy("src").count()._jdf.queryExecution().executedPlan().toString()
    for made in (operators.assign_layers(edges), operators.assign_layers(kept, dealt_by_src=True)):
        rows = made.collect()
        assert len(rows) == 8 and {r.v: r.layer for r in rows} == want
        # layers meet edges by vertex without another shuffle of the edges
        plan = kept.join(made.withColumnRenamed("v", "src").hint("merge"), "src")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan


def test_no_edges_go_through_the_driver(spark, monkeypatch):
    plans = []
    put = operators.written
    monkeypatch.setattr(operators, "written", lambda rows, name: plans.append((name, rows._jdf.queryExecution().executedPlan().toString())) or put(rows, name))
    edges = spark.createDataFrame([("a", "b", 0.5), ("b", "a", 0.4), ("b", "c", 0.9), ("c", "b", 0.1), ("x", "y", 0.2), ("y", "x", 0.2), ("d", "a", 0.3)], "src string, dst string, confidence double")
    assert sorted((r.src, r.dst) for r in operators.break_cycles(edges).collect()) == [("a", "b"), ("b", "c"), ("d", "a"), ("y", "x")]
    found = operators.simple_paths(edges, spark.createDataFrame([("d",)], "v string"), 3).collect()
    assert sorted(tuple(r.path) for r in found) == [("d", "a", "b", "c")]
    assert not any("Broadcast" in plan for name, plan in plans if name in ("edges", "grown", "done"))


def test_links_carry_no_more_than_their_file_needs(spark):
    nodes = [("a", -2, -3, None, None), ("b", 4, 2**31 - 1, 7.5, None), ("c", 0, 5, 0.0, 650.0)]
    edges = [("a", "b"), ("a", "c"), ("b", "c"), ("c", "lost")]
    path = scratch(spark, "layout")
    write_store(spark.createDataFrame(nodes, "v string, layer int, level int, x double, y double"), spark.createDataFrame(edges, "src string, dst string"), path)
    store = Store(spark, path)
    assert "in_rank" not in store.schemas["links_src"].names and "out_rank" not in store.schemas["links_dst"].names
    kept = {(r.src, r.dst): (r.src_x, r.src_y, r.dst_x, r.dst_y) for r in spark.read.parquet(f"{path}/links_src").collect()}
    assert kept == {("a", "b"): (None, None, 7.5, None), ("a", "c"): (None,) * 4, ("b", "c"): (7.5, None, None, None), ("c", "lost"): (None,) * 4}
    every = (-1e12, -1e12, 1e12, 1e12)
    want = {("a", -2, -3, -480.0, -390.0, True), ("b", 4, 2**31 - 1, 7.5, (2**31 - 1) * 130.0, True), ("c", 0, 5, 0.0, 650.0, True), ("lost", 0, 0, 0.0, 0.0, False)}
    assert {tuple(r) for r in store.blocks(*every).collect()} == want
    assert sorted(map(tuple, store.links(*every).collect())) == edges
    # a link whose ends are both in view comes once, by whichever end has room for it
    assert sorted(map(tuple, store.links(*every, 1).collect())) == [("a", "b"), ("a", "c"), ("b", "c"), ("c", "lost")]
