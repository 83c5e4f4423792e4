"""Hand tables for operators that SQL doesn't cover."""

import random

from pyspark.sql import functions as F

from inkgraph.operators import annotations as an
from inkgraph.operators import chains, graph, layout, text, voting
from inkgraph.sources import articles, exchange
from inkgraph.streaming import incremental

ARTICLE = """<article xmlns:xlink="http://www.w3.org/1999/xlink"><front><journal-meta><journal-title-group><journal-title>J</journal-title></journal-title-group></journal-meta>
<article-meta><article-id pub-id-type="pmid">11</article-id><article-id pub-id-type="pmc">PMC22</article-id><article-id pub-id-type="doi">10.1/x</article-id>
<title-group><article-title>A <i>big</i> title</article-title></title-group><contrib-group><contrib contrib-type="author"><name><surname>Doe</surname><given-names>Jo</given-names></name></contrib></contrib-group>
<pub-date><year>2020</year></pub-date><abstract><p>Short.</p></abstract><kwd-group><kwd> k1 </kwd><kwd>k2</kwd></kwd-group></article-meta></front>
<back><ref-list><ref id="1"><element-citation><article-title>One</article-title><year>1999</year><pub-id pub-id-type="pmid">101</pub-id></element-citation></ref>
<ref id="2"><element-citation><source>Two</source><pub-id pub-id-type="pmcid">PMC202</pub-id></element-citation></ref>
<ref id="3"><element-citation><article-title>Three</article-title><pub-id pub-id-type="doi">10.1/y</pub-id></element-citation></ref>
<ref id="4"><element-citation><ext-link xlink:href="http://z">z</ext-link></element-citation></ref>
<ref id="5"><element-citation><article-title>One</article-title><year>1999</year><pub-id pub-id-type="pmid">101</pub-id></element-citation></ref><ref id="6"/></ref-list></back></article>"""


def test_article_fields_and_references(spark):
    files = spark.createDataFrame([("a", ARTICLE), ("b", "<other/>"), ("c", "<article><front/></article>")], "path string, xml string")
    fields = articles.article_fields(files)
    rows = {r.uid: r for r in fields.collect()}
    assert len(rows) == 2 and rows["22"].title == "A big title" and rows["22"].authors == ["Jo Doe"] and rows["22"].keywords == ["k1", "k2"] and rows["22"].year == "2020"
    refs = articles.references(fields)
    assert refs.count() == 4
    assert {(r.src, r.dst) for r in articles.citation_edges(refs).collect()} == {("101", "22"), ("202", "22")}


def test_layers_of_random_graphs(spark):
    rng = random.Random(3)
    for n in (5, 8):
        edges = [(f"v{a}", f"v{b}") for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5] or [("v0", "v1")]
        df = spark.createDataFrame(edges, "src string, dst string")
        layers = {r.v: r.layer for r in graph.assign_layers(df).collect()}
        want = {}
        for v in sorted({x for e in edges for x in e}, key=lambda x: int(x[1:])):
            want[v] = max([want[a] + 1 for a, b in edges if b == v], default=0)
        assert layers == want
        frame = spark.createDataFrame(list(want.items()), "v string, layer int")
        assert graph.layer_violations(df, frame).count() == 0
        path = [r.v for r in graph.longest_path(df, frame).orderBy("position").collect()]
        assert len(path) == max(want.values()) + 1 and all((a, b) in edges for a, b in zip(path, path[1:]))


def test_cycles_are_reported(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("c", "d")], "src string, dst string")
    layers = graph.assign_layers(df)
    assert {r.v: r.layer for r in layers.collect()} == {"a": 0, "b": None, "c": None, "d": None}
    assert not graph.is_dag(layers).first().is_dag


def test_routes(spark):
    placed = spark.createDataFrame([("a", 0, 0, 0.0, 0.0), ("b", 3, 1, 720.0, 130.0)], "v string, layer int, level int, x double, y double")
    row = layout.routes(spark.createDataFrame([("a", "b")], "src string, dst string"), placed).first()
    assert len(row.points) == 4 and row.points[0].x == 200 and row.points[-1].x == 720 and [p.x for p in row.points] == sorted(p.x for p in row.points)


def test_token_votes(spark):
    rows = [
        (1, "p", 0, "ab", 0, 2, "NOUN", 0.9), (1, "q", 0, "ab", 0, 2, "NOUN", 0.7), (1, "r", 0, "abc", 0, 3, "VERB", 0.8),
        (1, "p", 1, "xy", 10, 12, "VERB", 0.9), (1, "q", 1, "xyzuv", 10, 15, "VERB", 0.9),  # overlap 0.4
        (1, "p", 2, "k", 20, 21, "NOUN", 0.9), (1, "p", 3, "k", 20, 21, "NOUN", 0.9),  # twice one processor
    ]
    df = spark.createDataFrame(rows, "doc_id long, processor string, idx int, text string, start long, end long, pos string, confidence double")
    got = sorted((r.start, r.end, r.pos, r.votes, r.agreed) for r in voting.vote_tokens(voting.cluster_tokens(df)).collect())
    assert got == [(0, 2, "NOUN", 2, True), (10, 12, "VERB", 1, False), (10, 15, "VERB", 1, False), (20, 21, "NOUN", 1, False)]


def test_markdown_lines_and_offsets(spark):
    doc = "---\nk: v\n---\n# T\n|a|b|\nBody one.\n## References\n[1] x"
    df = spark.createDataFrame([(1, doc), (2, "---\nopen"), (3, "")], "doc_id long, text string")
    lines = text.filtered_lines(df)
    got = {(r.doc_id, r.text): (r.filtered_start, r.original_start) for r in lines.collect()}
    assert got == {(1, "# T"): (0, 13), (1, "Body one."): (4, 23), (2, "---"): (0, 0), (2, "open"): (4, 4), (3, ""): (0, 0)}
    back = text.to_original(spark.createDataFrame([(1, 6), (1, -3), (2, 5)], "doc_id long, offset long"), lines)
    assert {(r.doc_id, r.offset): r.original for r in back.collect()} == {(1, 6): 25, (1, -3): 0, (2, 5): 5}
    assert doc[25] == "Body one."[2]


def test_shifts_after_edits(spark):
    spans = [("before", 0, 5), ("after", 50, 60), ("around", 5, 45), ("left", 5, 15), ("right", 25, 40), ("inside", 12, 18)]
    df = spark.createDataFrame([(n, 1, a, b) for n, a, b in spans], "uid string, doc_id long, start long, end long")
    edits = spark.createDataFrame([(1, 10, 30, 10)], "doc_id long, from long, to long, length long")
    got = {r.uid: (r.start, r.end) for r in an.shifted(df, edits).collect()}
    assert got == {"before": (0, 5), "after": (40, 50), "around": (5, 35), "left": (5, 10), "right": (20, 30), "inside": (11, 14)}
    gone = an.shifted(df, spark.createDataFrame([(1, 10, 30, 0)], "doc_id long, from long, to long, length long"))
    assert "inside" not in {r.uid for r in gone.collect()}


def test_nearest_actions(spark):
    actions = spark.createDataFrame([(1, 0, "a"), (1, 100, "b"), (2, 50, "c")], "doc_id long, pos int, id string")
    hits = spark.createDataFrame([(1, 40), (1, 2000), (2, 10)], "doc_id long, at int")
    got = {(r.doc_id, r.at): (r.before, r.after) for r in chains.nearest_actions(actions, hits).collect()}
    assert got == {(1, 40): ("a", "b"), (1, 2000): (None, None), (2, 10): (None, "c")}


def test_annotation_files(spark, tmp_path):
    ann = spark.createDataFrame([("u1", 1, "NOUN", 0, 4, "text", 0.5), ("u2", 1, "VERB", 90, 99, "far", None)], "uid string, doc_id long, annotation_type string, start long, end long, text string, confidence double")
    rel = spark.createDataFrame([("u1", "u2", "NEXT")], "source_uid string, target_uid string, relation_type string")
    exchange.write_annotations(ann, rel, f"{tmp_path}/a")
    good, bad = exchange.read_annotations(spark, f"{tmp_path}/a", spark.createDataFrame([(1, "text here")], "doc_id long, text string"))
    assert [r.uid for r in good.collect()] == ["u1"] and bad.first().error == "offsets outside the text" and good.first().source == "file"


def test_layer_stream_restarts(spark, tmp_path):
    source, store, check = f"{tmp_path}/in", f"{tmp_path}/store", f"{tmp_path}/check"
    batches = [[("a", "b"), ("b", "c")], [("x", "a"), ("c", "d"), ("a", "b")], [("d", "e")]]
    for k, edges in enumerate(batches):
        spark.createDataFrame(edges, "src string, dst string").coalesce(1).write.mode("append").parquet(source)
        incremental.layer_stream(spark, source, store, check).awaitTermination()
    got = {r.v: r.layer for r in incremental.stored_layers(spark, store, 3).collect()}
    assert got == {"x": 0, "a": 1, "b": 2, "c": 3, "d": 4, "e": 5}


def test_morpheme_lines(spark):
    lines = spark.createDataFrame([("walk/walk/ing | verb",), ("# no",), ("",), ("go/go",)], "value string")
    got = {r.word: (r.morphemes, r.comment) for r in articles.morpheme_dictionary(lines).collect()}
    assert got == {"walk": (["walk", "ing"], "verb"), "go": (["go"], None)}
    assert lines.select(F.lit(1)).count() == 4


def test_cycles_lose_their_weakest_edge(spark):
    rows = [("a", "b", 0.9), ("b", "a", 0.5), ("b", "c", 0.8), ("c", "d", 0.7), ("d", "b", 0.6), ("x", "y", 0.1)]
    df = spark.createDataFrame(rows, "src string, dst string, confidence double")
    assert {(r.src, r.dst) for r in graph.break_cycles(df).collect()} == {("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")}
    assert {(r.src, r.dst) for r in graph.cyclic_core(df).collect()} == {(a, b) for a, b, _ in rows[:5]}


def test_authors_and_references_one_by_one(spark):
    xml = """<article><front><article-meta><article-id pub-id-type="pmid">5</article-id><contrib-group>
    <contrib contrib-type="author"><name><surname>Consortium</surname></name></contrib><contrib contrib-type="editor"><name><surname>No</surname></name></contrib>
    <contrib contrib-type="author"><name><given-names>Jo</given-names><surname>Roe</surname></name></contrib><contrib contrib-type="author"><collab>A group</collab></contrib></contrib-group></article-meta></front>
    <back><ref-list><ref id="1"/><ref id="2"><element-citation><pub-id pub-id-type="pmid">7</pub-id></element-citation></ref><m:ref id="3"><m:pub-id pub-id-type="pmid">8</m:pub-id></m:ref></ref-list></back></article>""".replace("<article>", '<article xmlns:m="urn:x">')
    fields = articles.article_fields(spark.createDataFrame([("a", xml)], "path string, xml string"))
    assert fields.first().authors == ["Consortium", "Jo Roe"]
    assert sorted(r.pmid for r in articles.references(fields).collect()) == ["7", "8"]
