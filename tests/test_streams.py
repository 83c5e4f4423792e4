import os
import random

import pytest
from pyspark.sql import functions as F

from inkgraph.streaming import incremental as inc


def test_segments_cover_each_batch_once():
    for n in (0, 1, 15, 16, 17, 255, 256, 300, 5000):
        covered = [b for level, place in inc.segments(n) for b in range(place * 16**level, (place + 1) * 16**level)]
        assert covered == list(range(n))
        assert len(inc.segments(n)) <= 15 * 4


def test_log_joins_segments_and_reads_the_same(spark, tmp_path):
    folder = f"{tmp_path}/log"
    for n in range(17):
        inc.append_segment(spark.createDataFrame([(f"v{n % 3}", n)], inc.LAYER), folder, inc.LAYER, n, inc._highest)
    rows = inc._highest(inc.log_rows(spark, folder, inc.LAYER, 17))
    assert {tuple(r) for r in rows.collect()} == {("v0", 15), ("v1", 16), ("v2", 14)}
    assert spark.read.parquet(f"{folder}/level-1/0").count() == 3
    assert inc.remove_joined(spark, folder, 17) == 16 and os.listdir(f"{folder}/level-0") == ["16"]
    assert inc._highest(inc.log_rows(spark, folder, inc.LAYER, 17)).count() == 3


def put(spark, rows, schema, source):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)


def longest(edges):
    layers, more = {v: 0 for e in edges for v in e}, True
    while more:
        more = False
        for a, b in edges:
            if layers[b] <= layers[a]:
                layers[b], more = layers[a] + 1, True
    return layers


def test_layer_log_equals_layers_of_all_edges_and_holds_changes_only(spark, tmp_path):
    source, store, check = f"{tmp_path}/in", f"{tmp_path}/store", f"{tmp_path}/check"
    draw, edges = random.Random(5), set()
    for k in range(3):
        batch = [tuple(f"v{x:02}" for x in sorted(draw.sample(range(25), 2))) for _ in range(12)] + [("v03", "v03"), (None, "v01")]
        put(spark, batch + batch[:2], inc.EDGE, source)
        inc.layer_stream(spark, source, store, check).awaitTermination()
        before, edges = longest(edges), edges | {(a, b) for a, b in batch if a and a != b}
        want = longest(edges)
        assert {r.v: r.layer for r in inc.stored_layers(spark, store, k + 1).collect()} == want
        changed = {r.v: r.layer for r in spark.read.parquet(f"{store}/layers/level-0/{k}").collect()}
        assert changed == {v: n for v, n in want.items() if before.get(v) != n}


def test_batch_run_again_changes_nothing(spark, tmp_path):
    source, store = f"{tmp_path}/in", f"{tmp_path}/store"
    put(spark, [("a", "b"), ("b", "c")], inc.EDGE, source)
    for check in ("check", "again"):  # without its checkpoint the stream runs batch 0 once more
        inc.layer_stream(spark, source, store, f"{tmp_path}/{check}").awaitTermination()
    assert {r.v: r.layer for r in inc.stored_layers(spark, store, 1).collect()} == {"a": 0, "b": 1, "c": 2}
    assert inc.log_rows(spark, f"{store}/edges", inc.EDGE, 1).count() == 2


def test_cycle_is_an_error(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a")], inc.EDGE)
    with pytest.raises(RuntimeError, match="cycle"):
        inc.raised_layers(edges, spark.createDataFrame([], inc.LAYER), edges, max_rounds=4)


def test_article_log_upserts_and_names_stubs(spark, tmp_path):
    source, store, check = f"{tmp_path}/in", f"{tmp_path}/store", f"{tmp_path}/check"
    batches = [
        [("A", "first", [("S", " "), ("T", None)]), ("A", "firsu", None), (None, "no id", None)],
        [("B", "second", [("S", "stub named"), ("A", "not this"), ("B", "self")])],
        [("C", None, [("S", "too late"), ("T", "named")]), ("A", "newer", [("S", "x")])],
        [("T", "loaded", [])],
    ]
    for rows in batches:
        put(spark, rows, inc.ARTICLE, source)
        inc.article_stream(spark, source, store, check).awaitTermination()
    got = {tuple(r) for r in inc.stored_articles(spark, store, 4).collect()}
    assert got == {("A", "newer", "unprocessed"), ("B", "second", "unprocessed"), ("C", None, "unprocessed"), ("T", "loaded", "unprocessed"), ("S", "stub named", "stub")}
    assert sorted(tuple(r) for r in inc.stored_links(spark, store, 4).collect()) == [("A", "B"), ("S", "A"), ("S", "B"), ("S", "C"), ("T", "A"), ("T", "C")]
    assert spark.read.parquet(f"{store}/links/level-0/2").where(F.col("dst") == "A").isEmpty()
