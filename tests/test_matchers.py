import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkgraph.operators import actions, annotations, chains, dictionary, graph, paths


def test_hits_equal_those_of_single_patterns(spark):
    rng = np.random.default_rng(6)
    terms = ["a", "ab", "aBa", "ba b", "é", "É", "aa", "x.y", "Σ", "İ", "straße", ""]
    docs = [(int(k), "".join(rng.choice(list("aAbB éÉx.yΣİs"), 200))) for k in range(60)] + [(70, None), (71, ""), (72, "Straße STRASSE İab"), (73, "ab" * 40_000), (3, "ab")]
    df = spark.createDataFrame([(*d, 9) for d in docs], "doc_id long, text string, start int").repartition(5)
    table = spark.createDataFrame([(t, 1) for t in [*terms, "ab", None]], "term string, n int")
    want = []
    for k, text in docs:
        low = dictionary.folded(text or "")
        for t in set(terms) - {""}:
            want += [(k, t, m.start(), m.end(), text[m.start():m.end()]) for m in re.finditer(re.escape(dictionary.folded(t)), low)]
    for size in (dictionary.BLOCK_BYTES, 4):
        assert sorted(map(tuple, dictionary.dictionary_hits(df, table, block_bytes=size).collect())) == sorted(want)
    whole = {(r.doc_id, r.start, r.end) for r in dictionary.dictionary_hits(df, table, words_only=True).collect()}
    edge = lambda text, k: 0 <= k < len(text) and text[k].isalnum()
    assert (72, 0, 6) in whole and not any(edge(dict(docs[:60]).get(k, ""), s - 1) for k, s, _ in whole if k < 60 and k != 3)
    assert dictionary.dictionary_hits(df, table.limit(0)).count() == 0 and dictionary.dictionary_hits(df.limit(0), table).count() == 0


def test_cascade_of_any_priorities(spark):
    rng = np.random.default_rng(8)
    rows = sorted({(int(d), int(s), int(s + n), None if p == 6 else int(p) * 3) for d, s, n, p in zip(rng.integers(0, 4, 200), rng.integers(0, 120, 200), rng.integers(1, 9, 200), rng.integers(1, 7, 200))}, key=str)
    kept = []
    for level in sorted({r[3] for r in rows}, key=lambda x: (x is None, x or 0)):
        stage = [r for r in rows if r[3] == level and not any(r[0] == k[0] and r[1] < k[2] and k[1] < r[2] for k in kept)]
        kept += stage
    df = spark.createDataFrame(rows, "doc_id long, start long, end long, priority int")
    got = [tuple(r) for r in actions.without_overlaps(df).collect()]
    assert sorted(got, key=str) == sorted(kept, key=str) and len({r[3] for r in got}) == 6
    assert actions.without_overlaps(df.limit(0)).count() == 0


@pytest.mark.parametrize("maximal", [True, False])
def test_best_paths_equal_enumeration(spark, maximal):
    rng = np.random.default_rng(12)
    for n, share in ((9, 0.5), (12, 0.35), (4, 0.0)):
        edges = {(f"v{a}", f"v{b}"): float(rng.integers(1, 4)) / 10 for a, b in itertools.combinations(range(n), 2) if rng.random() < share}
        into, out = {b for _, b in edges}, {a for a, _ in edges}
        found = []

        def walk(path):
            if len(path) > 2 and (not maximal or path[-1] not in out):
                steps = [edges[e] for e in zip(path, path[1:])]
                found.append((-len(steps), -round(sum(steps) * 1e6), path))
            for a, b in edges:
                if a == path[-1]:
                    walk([*path, b])

        for v in sorted(out - into):
            walk([v])
        want = [(p, -n) for n, _, p in sorted(found)[:7]]
        rows = [(a, b, c) for (a, b), c in edges.items()] + [("v1", "v1", 1.0), (None, "v2", 1.0)] + [(a, b, 0.0) for a, b in list(edges)[:3]]
        got = paths.best_paths(spark.createDataFrame(rows, "src string, dst string, confidence double"), 7, maximal=maximal).orderBy("rank").collect()
        assert [(r.path, r.length) for r in got] == want
        assert [r.confidence for r in got] == [round(-s / 1e6 / -n, 6) for n, s, _ in sorted(found)[:7]]


def test_best_paths_refuse_a_cycle(spark):
    with pytest.raises(ValueError):
        paths.best_paths(spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "b", 1.0)], "src string, dst string, confidence double"))


def test_parts_of_all_neighbours_in_reach(spark):
    text = "a b c d e part of z" + " " * 120 + "in y"
    ents = [(1, 0, m.start(), m.end(), m.group()) for m in re.finditer(r"\b[a-ez]\b", text)] + [(1, 0, len(text) - 1, len(text), "y"), (1, 1, 5, 6, "other")]
    rows = actions.parts_of(spark.createDataFrame(ents, "doc_id long, sent_idx long, start long, end long, text string"), spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert sorted((r.part, r.whole) for r in rows) == [(x, "z") for x in "abcde"]


def test_gaps_of_parts_come_from_two_stretches_of_their_text(spark):
    text = "\U0001F600" * 95 + "ab in cd" + "-" * 90 + "ef within\ngh"
    ents = [(1, 0, m.start(), m.end(), m.group()) for m in re.finditer("ab|cd|ef|gh", text)]
    made = actions.parts_of(spark.createDataFrame(ents, "doc_id long, sent_idx long, start long, end long, text string"), spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert sorted((r.part, r.whole, r.confidence) for r in made.collect()) == [("ab", "cd", 0.8), ("ab", "ef", 0.75), ("cd", "gh", 0.75), ("ef", "gh", 0.8)]
    assert made._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1  # a text is cut once, not for each pair


def test_edits_follow_each_other(spark):
    text = "".join(chr(97 + k % 26) for k in range(60))
    spans = [(f"u{s}-{t}", 1, s, t) for s, t in itertools.combinations(range(0, 60, 7), 2)] + [("other", 2, 3, 9)]
    df = spark.createDataFrame(spans, "uid string, doc_id long, start long, end long")
    edits = [(1, 10, 20, 0), (1, 30, 40, 0), (1, 50, 50, 5), (1, None, 1, 1)]
    cut = spark.createDataFrame(edits, "doc_id long, from long, to long, length long")
    got = {r.uid: (r.start, r.end) for r in annotations.shifted(df, cut).collect()}
    new = text[:10] + text[20:30] + text[40:50] + "-----" + text[50:]
    for uid, _, s, t in spans[:-1]:
        if not any(a < s < b or a < t < b for _, a, b, _ in edits[:2]) and not s < 50 < t:
            assert new[slice(*got[uid])] == text[s:10 if s < 10 else t][:0] + "".join(text[k] for k in range(s, t) if not 10 <= k < 20 and not 30 <= k < 40), uid
    assert got["other"] == (3, 9)
    # the second edit means the text that the first one left
    steps = spark.createDataFrame([(1, 1, 0, 0, 10), (1, 2, 0, 5, 0)], "doc_id long, seq int, from long, to long, length long")
    assert {r.uid: (r.start, r.end) for r in annotations.shifted(df, steps).collect()}["u7-14"] == (12, 19)


def test_pairs_of_verbs_far_apart(spark):
    words = "v0 then v1 v2 v3 v4 v5 v6 v7".split()
    tokens = spark.createDataFrame([(1, 0, k, w, "VERB" if w[0] == "v" else "ADV") for k, w in enumerate(words)], "doc_id long, sent_idx long, token_idx int, text string, pos string")
    deps = spark.createDataFrame([], "doc_id long, sent_idx long, head int, dependent int, relation string")
    links = spark.createDataFrame([], "doc_id long, sent_idx long, a int, b int, relation string")
    rows = chains.sequences(tokens, deps, links).collect()
    assert sorted((r.a, r.b, r.confidence) for r in rows) == [(0, k, 0.75) for k in range(2, 9)]


def test_published_nominalizations(spark):
    tokens = spark.createDataFrame([(1, 0, k, w, "NOUN", lemma) for k, (w, lemma) in enumerate([("Mutations", "mutation"), ("overexpression", None), ("table", "table")])], "doc_id long, sent_idx long, token_idx int, text string, pos string, lemma string")
    rows = {r.noun: r.action for r in actions.nominalizations(tokens).collect()}
    assert rows == {"mutation": "mutation", "overexpression": "expression"}
    assert actions.nominalization_table(spark).groupBy("noun").agg(F.count("*").alias("n")).where("n > 1").count() == 0


def test_top_chains_equal_enumeration(spark):
    rng = np.random.default_rng(21)
    rows = []
    for doc in range(4):
        for x, y in itertools.combinations([(int(s), int(t)) for s in range(3) for t in range(3)], 2):
            if rng.random() < 0.3:
                rows.append((doc, *x, *y, str(rng.choice(["CAUSAL", "RESULT"])), float(rng.integers(7, 10)) / 10))
    found = []
    for doc in range(4):
        steps = {((r[1], r[2]), (r[3], r[4])): round(r[6] * 1e6) for r in rows if r[0] == doc}
        into, out = {b for _, b in steps}, {a for a, _ in steps}

        def walk(path, total):
            if path[-1] not in out:
                if len(path) > 2:
                    found.append((1 - len(path), -total, doc, path[::-1]))
                return
            for (a, b), c in steps.items():
                if a == path[-1]:
                    walk([*path, b], total + c)

        for v in out - into:
            walk([v], 0)
    want = [(d, [tuple(v) for v in p[::-1]]) for _, _, d, p in sorted(found)[:12]]
    df = spark.createDataFrame(rows, "doc_id long, sent_a long, a long, sent_b long, b long, sequence_type string, confidence double")
    got = {}
    for r in sorted(chains.top_chains(df, 12).collect(), key=lambda r: (r["rank"], r.position)):
        got.setdefault(r["rank"], (r.doc_id, []))[1].append((r.sent_idx, r.token_idx))
    assert [got[k] for k in sorted(got)] == want
    assert chains.top_chains(df.limit(0)).count() == 0


def test_order_of_a_cyclic_graph(spark):
    layers = graph.assign_layers(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b")], "src string, dst string"))
    assert [r.v for r in graph.topological_order(layers).collect()] == ["a"]
    with pytest.raises(ValueError):
        graph.topological_order(layers, strict=True)
