import random

from pyspark.sql import functions as F

from inkgraph.operators import graph, reach


def closure(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    reached = {}
    for v in {x for e in edges for x in e}:
        seen, todo = {v}, [v]
        while todo:
            for w in out.get(todo.pop(), ()):
                if w not in seen:
                    seen.add(w)
                    todo.append(w)
        reached[v] = seen
    return reached


def frame(spark, rows, names):
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))


def random_graph(seed, n, m, cyclic):
    draw = random.Random(seed)
    out = set()
    while len(out) < m:
        a, b = draw.randrange(n), draw.randrange(n)
        if cyclic or a < b:
            out.add((f"v{a}", f"v{b}"))
    return sorted(out)


def check(spark, edges, n, seed, size):
    draw = random.Random(seed)
    pairs = [(f"v{draw.randrange(n)}", f"v{draw.randrange(n)}") for _ in range(150)] + [("x", "x"), ("x", "v0"), ("v0", "x")]
    reached = closure(edges)
    want = {(a, b) for a, b in pairs if b in reached.get(a, {a})}
    got = reach.reaching_pairs(frame(spark, edges, ["src", "dst"]), frame(spark, pairs + pairs[:5] + [(None, "v1")], ["start", "goal"]), size).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == want


def test_acyclic_graph_with_small_labels(spark):
    check(spark, random_graph(1, 60, 110, False), 60, 2, 2)


def test_graph_with_cycles_loops_and_a_hub(spark):
    edges = random_graph(3, 40, 50, True) + [("v5", "v5")] + [("hub", f"v{k}") for k in range(40)]
    check(spark, edges, 40, 4, 3)


def test_labels_answer_most_pairs_of_a_deep_graph(spark):
    # two long chains with rungs: the closure has thousands of rows, the labels leave few pairs open
    edges = [(f"a{k:02}", f"a{k + 1:02}") for k in range(24)] + [(f"b{k:02}", f"b{k + 1:02}") for k in range(24)] + [(f"a{k:02}", f"b{k:02}") for k in range(0, 24, 6)]
    names = sorted({x for e in edges for x in e})
    reached = closure(edges)
    pairs = [(a, b) for a in names for b in names if a != b]
    labels = reach.reach_labels(frame(spark, edges, ["src", "dst"]))
    assert labels.agg(F.max(F.size("label"))).first()[0] <= 8
    answers = reach.label_answers(frame(spark, pairs, ["start", "goal"]), labels).collect()
    assert len(answers) == len(pairs)
    assert all(r.answer == (r.goal in reached[r.start]) for r in answers if r.answer is not None)
    assert sum(r.answer is None for r in answers) < len(pairs) / 3 < sum(len(s) for s in reached.values())


def test_links_refused(spark):
    edges = frame(spark, [("a", "b"), ("b", "c")], ["src", "dst"])
    new = frame(spark, [("c", "a", "1"), ("a", "c", "2"), ("d", "d", "3"), ("c", "d", "4"), (None, "a", "5"), ("c", "a", "6")], ["src", "dst", "note"])
    kept, refused = reach.accepted_links(edges, new)
    assert sorted(r.note for r in kept.collect()) == ["2", "4"]
    assert sorted(r.note for r in refused.collect()) == ["1", "3", "5", "6"]


def test_no_edges_no_pairs(spark):
    none = frame(spark, [], ["src", "dst"])
    assert reach.would_close_cycle(none, none).isEmpty()
    assert reach.would_close_cycle(none, frame(spark, [("a", "a"), ("a", "b")], ["src", "dst"])).count() == 1


def every_path(edges, start, goal, cutoff):
    found, todo = [], [[start]]
    while todo:
        path = todo.pop()
        if path[-1] == goal:
            found.append(tuple(path))
        elif len(path) <= cutoff:
            todo += [path + [b] for a, b in edges if a == path[-1] and b not in path]
    return sorted(found)


def test_paths_between_equal_an_enumeration(spark):
    edges = random_graph(7, 14, 34, True) + [("v3", "v3")]
    pairs = [(f"v{a}", f"v{b}") for a, b in [(0, 9), (9, 0), (4, 4), (2, 13), (11, 5), (1, 99)]] + [("v0", "v9"), (None, "v1")]
    for cutoff in (3, 5):
        got = sorted((r.start, r.goal, tuple(r.path)) for r in graph.paths_between(frame(spark, edges, ["src", "dst"]), frame(spark, pairs, ["start", "goal"]), cutoff).collect())
        assert got == sorted((a, b, p) for a, b in set(pairs) if a for p in every_path(edges, a, b, cutoff) if a != b or len(p) == 1)


def test_report_of_small_graphs(spark):
    edges = frame(spark, [("a", "b"), ("b", "c"), ("x", "y")], ["src", "dst"])
    points = frame(spark, [("a",), ("b",), ("c",), ("x",), ("y",), ("z",), ("z",)], ["v"])
    assert tuple(graph.graph_report(edges, points).first()) == (6, 1, 3, 3, 50.0, 0.6, 0.6, True)
    loop = frame(spark, [("a", "b"), ("b", "a")], ["src", "dst"])
    assert graph.graph_report(loop, points).first().is_dag is False
    none = frame(spark, [], ["src", "dst"])
    assert tuple(graph.graph_report(none, points.where("v = 'z'")).first()) == (1, 1, 1, 1, 100.0, None, None, True)
    assert tuple(graph.graph_report(none, points.where("v = '-'")).first()) == (0, 0, 0, 0, None, None, None, True)
    placed = spark.createDataFrame([("a", 1, 2.0), ("z", 3, 4.0)], "v string, layer int, x double")
    assert sorted(map(tuple, graph.without_coordinates(placed, points.where("v = 'z'")).collect())) == [("a", 1, 2.0), ("z", None, None)]


def test_only_edges_between_starts_and_goals_are_kept(spark, monkeypatch):
    edges = random_graph(11, 60, 150, False) + [(f"far{k}", f"far{k + 1}") for k in range(50)]
    starts, goals = [f"v{k}" for k in (1, 2, 3)], ["v40", "v41", "nowhere"]
    reached = closure(edges)
    want = {(a, b) for a, b in edges if any(a in reached.get(s, {s}) for s in starts) and any(g in reached[b] for g in goals)}
    assert 0 < len(want) < len(edges) / 2
    rows = frame(spark, edges + edges[:9], ["src", "dst"])
    got = list(map(tuple, reach.edges_between(rows, frame(spark, [(v,) for v in starts], ["v"]), frame(spark, [(v,) for v in goals], ["v"])).collect()))
    assert len(got) == len(set(got)) and set(got) == want
    labelled, whole = [], reach.reach_labels
    monkeypatch.setattr(reach, "reach_labels", lambda kept, *more: labelled.append(kept.count()) or whole(kept, *more))
    pairs = [(a, b) for a in starts for b in goals]
    found = {tuple(r) for r in reach.reaching_pairs(rows, frame(spark, pairs, ["start", "goal"])).collect()}
    assert labelled == [len(want)] and found == {(a, b) for a, b in pairs if b in reached[a]}
