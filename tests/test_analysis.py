"""Operators that SQL does not cover, against plain Python."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from inkgraph.operators import actions, graph, text, voting
from inkgraph.operators.chains import success_patterns


def reaches(edges, a, b):
    seen, todo = set(), [a]
    while todo:
        v = todo.pop()
        for x, y in edges:
            if x == v and y not in seen:
                seen.add(y)
                todo.append(y)
    return b in seen


def test_cycles_are_broken_inside_strong_components_only(spark):
    bridge = [("a", "b", 0.9), ("b", "c", 0.8), ("c", "a", 0.7), ("c", "d", 0.1), ("d", "e", 0.9), ("e", "d", 0.6), ("f", "a", 0.05)]
    kept = {(r.src, r.dst) for r in graph.break_cycles(spark.createDataFrame(bridge, "src string, dst string, confidence double")).collect()}
    assert {(a, b) for a, b, _ in bridge} - kept == {("c", "a"), ("e", "d")}
    rng = random.Random(3)
    edges = sorted({(f"v{rng.randrange(8)}", f"v{rng.randrange(8)}") for _ in range(16)})
    rows = [(a, b, round(rng.random(), 3)) for a, b in edges if a != b]
    left = [(r.src, r.dst) for r in graph.break_cycles(spark.createDataFrame(rows, "src string, dst string, confidence double")).collect()]
    assert not any(reaches(left, b, a) for a, b in left)
    gone = {(a, b) for a, b, _ in rows} - set(left)
    assert all(reaches([(x, y) for x, y, _ in rows], b, a) for a, b in gone)  # only edges of cycles go


def test_marker_hits_and_purposes(spark):
    docs = ["He sat then left because of rain, thus the roof leaks.", "It is to be seen; they came to help.", "", None]
    rows = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {(r.doc_id, r.at, r.relation, r.marker) for r in actions.marker_hits(rows).collect()}
    want = set()
    for k, doc in enumerate(docs[:3]):
        for relation, _, _, patterns in actions.MARKERS:
            for p in patterns:
                for m in re.finditer(p, doc, re.I):
                    before, after = doc[: m.start()].lower().split(), doc[m.end() :].lower().split()
                    if relation == "PURPOSE" and (before[-1:] and before[-1] in ("is", "be", "was", "were", "been") or after[:1] and after[0] in ("be", "have", "seem", "appear")):
                        continue
                    want.add((k, m.start(), relation, m.group(1).lower() if m.groups() and len(m.group(1)) == len(m.group()) else m.group().lower()))
    assert got == want and any(r[2] == "CAUSES" for r in got) and sum(r[2] == "PURPOSE" for r in got) == 1
    verbs = spark.createDataFrame([(0, 3, "sat"), (0, 12, "left"), (0, 48, "leaks")], "doc_id long, pos int, id string")
    links = {(r.src, r.dst, r.relation) for r in actions.marker_dependencies(verbs, actions.marker_hits(rows)).collect()}
    assert ("sat", "left", "TEMPORAL_BEFORE") in links and ("leaks", "left", "CAUSES") in links


def test_abbreviations(spark):
    df = spark.createDataFrame([(1, "The Large Word Model (LWM) beats Other Thing (XY)."), (2, "no (AB)")], "doc_id long, text string")
    assert [(r.doc_id, r.short, r.long) for r in actions.abbreviations(df).collect()] == [(1, "LWM", "Large Word Model")]


def test_parts_need_a_marker(spark):
    doc = "cat, dog. The wheel of part of car"
    ents = spark.createDataFrame([(1, 0, 0, 3, "cat"), (1, 0, 5, 8, "dog"), (1, 1, 14, 19, "wheel"), (1, 1, 31, 34, "car")], "doc_id long, sent_idx long, start long, end long, text string")
    got = [(r.part, r.whole) for r in actions.parts_of(ents, spark.createDataFrame([(1, doc)], "doc_id long, text string")).collect()]
    assert got == [("wheel", "car")]


def test_depth_is_that_of_the_longest_path(spark):
    e = spark.createDataFrame([("a", "b", "CAUSES"), ("b", "c", "BEFORE"), ("a", "c", "BEFORE")], "src string, dst string, relation string")
    row = success_patterns(e, spark.createDataFrame([("c",)], "id string")).first()
    assert (row["size"], row.depth, row.width, row.causal, row.score) == (3, 2, 2, 1, 10)


def test_chunks_overlap_by_whole_sentences(spark):
    sentence = "This is sentence number {} here."
    doc = "\n".join(" ".join(sentence.format(10 * p + k) for k in range(3)) for p in range(6))
    rows = text.chunks(spark.createDataFrame([(1, doc)], "doc_id long, text string"), 40, 10).orderBy("chunk_no").collect()
    assert len(rows) > 2
    for a, b in zip(rows, rows[1:]):
        first = b.text.split("\n")[0]
        assert a.text.endswith(first) and len(first) <= 40
    plain = text.chunks(spark.createDataFrame([(1, doc)], "doc_id long, text string"), 40).orderBy("chunk_no").collect()
    assert "\n".join(r.text for r in plain) == doc


def test_captions_and_parsing(spark):
    html = "a <table><tr></tr></table> b <TABLE><caption class='x'>Cap</caption><td>1</td></TABLE> c <figure><img><figcaption>Fig</figcaption></figure>"
    assert spark.createDataFrame([(html,)], "t string").select(text.captions_only(F.col("t"))).first()[0] == "a  b Cap c Fig"
    row = text.parsed(spark.createDataFrame([(1, "---\ntitle: X y\nyear: 2001\n---\nBody\n[1]: first ref\n[12]: other")], "doc_id long, text string")).first()
    assert row.front == {"title": "X y", "year": "2001"} and row.references == {"1": "first ref", "12": "other"} and row.body.startswith("Body")


def test_entity_clusters_by_any_member(spark):
    rng = random.Random(4)
    spans = sorted({(1 + k % 2, a, a + rng.randint(2, 9)) for k in range(60) for a in [rng.randrange(60)]})
    got = voting.cluster_entities(spark.createDataFrame(spans, "doc_id long, start long, end long")).collect()
    cluster = {(r.doc_id, r.start, r.end): r.cluster for r in got}
    parent = {s: s for s in spans}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in spans:
        for b in spans:
            if a[0] == b[0] and max(0, min(a[2], b[2]) - max(a[1], b[1])) / (max(a[2], b[2]) - min(a[1], b[1])) >= 0.5:
                parent[root(a)] = root(b)
    assert all((cluster[a] == cluster[b]) == (root(a) == root(b)) for a in spans for b in spans)


def test_entity_clusters_list_no_pairs(spark):
    spans = [(1, 0, 10, "a")] * 2000 + [(1, 1, 10, "b"), (1, 9, 12, "c"), (1, 20, 20, "d"), (2, 0, 10, "e"), (None, 0, 1, "f"), (2, None, 1, "g")]
    made = voting.cluster_entities(spark.createDataFrame(spans, "doc_id long, start int, end int, text string"))
    assert "Join" not in made._jdf.queryExecution().executedPlan().toString()
    got = {(r.doc_id, r.text, r.cluster): r["count"] for r in made.groupBy("doc_id", "text", "cluster").count().collect()}
    one = "1:000000000000:000000000010"
    assert got == {(1, "a", one): 2000, (1, "b", one): 1, (1, "c", "1:000000000009:000000000012"): 1, (1, "d", "1:000000000020:000000000020"): 1, (2, "e", "2:000000000000:000000000010"): 1}
    # thousands of spans that overlap: lags are gone through in arrays
    assert voting.chained_spans(np.arange(3000), np.arange(3000) + 2000, 0.5).max() == 0


def test_passives_have_agent_and_patient(spark):
    sentences = ["growth was inhibited by iron", "iron is an activator made by cells", "was blocked by salt", "growth was inhibited"]
    nouns = {"growth", "iron", "cells", "salt"}
    rows = [(1, k, i, w, "NOUN" if w in nouns else "VERB") for k, s in enumerate(sentences) for i, w in enumerate(s.split())]
    tokens = spark.createDataFrame(rows, "doc_id long, sent_idx int, token_idx int, text string, pos string")
    got = {(r.sent_idx, r.verb, r.agent, r.patient, r.relation) for r in actions.passives(tokens).collect()}
    assert got == {(0, "inhibited", "iron", "growth", "PREVENTS"), (1, "activator", "cells", "iron", "ENABLES"), (2, "blocked", "salt", None, "PREVENTS")}


def test_coordinated_words_need_no_text(spark, tmp_path):
    """Words with the gaps before them give what entities and texts give, and no text is joined."""
    from inkgraph.operators import actions
    from inkgraph.plans import adapters, registry

    rng = random.Random(9)
    texts = ["alpha, beta and gamma or delta. Epsilon, AND zeta  eta1, iota", "alpha_and_beta, gamma\nand\tdelta,or omega x and kappa", "alpha,,beta , and, gamma" + " " * 30 + ", delta, " + "é" * 5, None, ""]
    texts += ["".join(rng.choice(["alpha", "beta", "and", "or", "xy", ",", " ", " ", ", ", "_", ".", "\n"]) for _ in range(60)) for _ in range(40)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs, entities = spark.read.parquet(f"{tmp_path}/documents.parquet"), adapters.sentence_words(spark, str(tmp_path)).where("pos = 'NOUN' AND length(text) >= 4")
    found = registry.queries()["actions_coordinated"](spark, str(tmp_path))
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString() and "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, found.collect()))
    assert got == sorted(map(tuple, actions.coordinations(entities, docs).collect())) and len(got) > 20
    assert (0, "alpha", "delta", 0.7) in got


def test_markers_are_looked_for_where_a_piece_of_them_is(spark, monkeypatch):
    """No match is lost by it: texts of marker words give what all patterns give without it."""
    from inkgraph.operators import actions
    from inkgraph.operators.markers import MARKERS, needed

    assert needed(r"\b(plays? a (?:key |major )?role in|thus)\b") == ["role in", "thus"] and needed(r"\b(a|b).*(c)\b") == []
    rng = random.Random(3)
    # one text for each way to read a pattern: optional pieces in or out, each alternative
    texts = []
    for p in (p for m in MARKERS for p in m[3]):
        for _ in range(6):
            t = p.replace(r"\b", "").replace(r"\s+", " ").replace(r"\w+", "bind").replace(".*", " x ")
            t = re.sub(r"(\w)\?", lambda m: rng.choice(["", m[1]]), t.replace("(?:", "("))
            while "(" in t:
                t = re.sub(r"\(([^()]*)\)(\??)", lambda m: "" if m[2] and rng.random() < 0.5 else rng.choice(m[1].split("|")), t, count=1)
            texts.append(rng.choice(["we ", ""]) + rng.choice([t, t.upper(), t.title()]) + rng.choice([" it", ""]))
    texts += [" ".join(rng.sample(texts, 12)) for _ in range(20)] + [None, "", "nothing"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = sorted(map(tuple, actions.marker_hits(docs).collect()))
    monkeypatch.setattr(actions, "needed", lambda p: [])
    assert got == sorted(map(tuple, actions.marker_hits(docs).collect())) and len({r[0] for r in got}) > 500


def test_texts_are_gone_through_once_for_markers(spark):
    from inkgraph.operators import actions

    docs = spark.createDataFrame([(1, "we see a thing then do it")], "doc_id long, text string")
    verbs = spark.createDataFrame([(1, 3, "see"), (1, 20, "do")], "doc_id long, pos int, id string")
    found = actions.marker_dependencies(verbs, actions.marker_hits(docs))
    assert "regexp_extract_all" not in found._jdf.queryExecution().toString()
    assert [(r.src, r.dst, r.marker) for r in found.collect()] == [("see", "do", "then")]
