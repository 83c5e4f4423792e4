import random

import pytest

from inkgraph.llm.mixing import Mix, calibrated, keep_mix, mix_report, raked, sample_mix


def test_raking_reaches_all_marginals():
    rng = random.Random(1)
    tokens = {(a, b, c): rng.randint(1, 1000) for a in "xyz" for b in "pq" for c in "mn"}
    targets = [{"x": 1, "y": 2, "z": 3, "w": 9}, {"p": 0.9, "q": 0.1}, {"m": 0.5, "n": 0.5}]
    share = raked(tokens, targets, 200)
    for k, name, want in ((0, "x", 1 / 6), (0, "z", 0.5), (1, "q", 0.1), (2, "m", 0.5)):
        assert sum(v for c, v in share.items() if c[k] == name) == pytest.approx(want, abs=1e-9)
    p = calibrated(tokens, share, 0.4)
    assert sum(p[c] * tokens[c] for c in p) == pytest.approx(0.4 * sum(tokens.values()))
    assert max(p.values()) <= 1 and calibrated(tokens, share, 1.0)


def test_rows_nulls_and_clashes(spark):
    rows = [(k, "tion word ing" if k % 2 else "ment ment", "en" if k % 3 else None, "src1" if k % 5 else "unknown", 1.0) for k in range(600)]
    rows += [(None, None, None, None, 1.0), (7, "", "xx", "src1", 2.0), (1, rows[1][1], "en", "src1", 5.0), (9000, "a " * 50000, "en", "src1", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, probability double")
    got = sample_mix(docs).collect()
    kept = keep_mix(docs)
    assert kept.columns == docs.columns and 0 < kept.count() == len(got) < len(rows)
    assert sum(r.n_tokens for r in sample_mix(docs, Mix(take=1.0, sources={"*": 1, "src1": 1})).collect()) > 0
    assert sample_mix(docs.limit(0)).count() == 0
    assert sample_mix(docs, Mix(sources={"none": 1.0})).count() == 0


def test_bounded_cells_leave_the_marginals_whole():
    # a third of all tokens is wanted from y, which has few of them in p; its other cells make up for that
    tokens = {("x", "p", "t"): 900.0, ("x", "q", "t"): 600.0, ("y", "p", "t"): 100.0, ("y", "q", "t"): 400.0}
    targets = [{"x": 0.6, "y": 0.4}, {"p": 0.6, "q": 0.4}, {"t": 1}]
    for take in (0.4, 0.5):
        p = calibrated(tokens, raked(tokens, targets, 400, 1 / take), take)
        drawn = sum(p[c] * n for c, n in tokens.items())
        assert drawn == pytest.approx(take * 2000)
        assert sum(p[c] * n for c, n in tokens.items() if c[0] == "y") / drawn == pytest.approx(0.4, abs=1e-6)
        assert sum(p[c] * n for c, n in tokens.items() if c[1] == "p") / drawn == pytest.approx(0.6, abs=1e-6)
        assert max(p.values()) <= 1
    assert calibrated(tokens, raked(tokens, targets, 50, 1.0), 1.0) == pytest.approx(dict.fromkeys(tokens, 1.0))


def test_drawn_marginals_and_report(spark):
    rows = [(k, "tion " * (1 + k % 7), "en" if k % 4 else "de", "src1" if k % 3 else "src2") for k in range(20000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    mix = Mix(sources={"src1": 0.5, "src2": 0.5}, languages={"en": 0.6, "de": 0.4}, topics={"process": 1.0}, take=0.4, rounds=50)
    report = {(r.dimension, r.category): r for r in mix_report(docs, mix).collect()}
    drawn = sample_mix(docs, mix).collect()
    whole = sum(r.n_tokens for r in drawn)
    for dimension, category, want in (("source", "src1", 0.5), ("lang", "de", 0.4), ("topic", "process", 1.0)):
        assert report[dimension, category].target == pytest.approx(want) == pytest.approx(report[dimension, category].expected, abs=1e-6)
        assert sum(r.n_tokens for r in drawn if r[dimension] == category) / whole == pytest.approx(want, abs=0.02)
    assert whole / sum(1 + k % 7 for k in range(20000)) == pytest.approx(0.4, abs=0.02)
    assert report["source", "src1"].available == pytest.approx(2 / 3, abs=0.01)
    assert mix_report(docs.limit(0), mix).count() == 0
