import random

import numpy as np
import pyarrow as pa

from inkgraph.llm import bytes as by
from inkgraph.llm import quality


def made(rng, n):
    words = ["lamp", "river", "stone", "green", "walk", "of", "the"]
    rows = []
    for k in range(n):
        bad = k % 3 == 0
        picked = rng.choices(words, k=rng.randint(20, 120))
        rows.append((k, " ".join(w.upper() + "%%!" if bad else w for w in picked), 0 if bad else 1))
    return rows


def test_padding_and_runs_do_not_change_a_score():
    net = quality.fresh(1)
    texts = ["", "a", "word " * 5000, "é" * 333, "x" * 255, "y" * 256, "z" * 300000]
    data, offsets = by.flat(pa.array(texts))
    together = quality.probabilities(net, data, offsets)
    alone = [quality.probabilities(net, *by.flat(pa.array([t])))[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-4)


def test_every_place_reaches_the_maximum():
    net = quality.fresh(2)
    text = b"q" * 700
    for at in (0, 100, 254, 255, 256, 690):
        one = text[:at] + b"#ZZZ%" + text[at + 5 :]
        codes, _ = quality.chunked(np.frombuffer(one, np.uint8), np.array([0, len(one)]))
        plain, _ = quality.chunked(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert not np.allclose(quality.responses(net, codes, np.array([2])), quality.responses(net, plain, np.array([2])))


def test_held_out_accuracy_and_edge_cases(spark):
    rng = random.Random(2)
    rows = made(rng, 400)
    docs = spark.createDataFrame([(a, b, 9.0) for a, b, _ in rows] + [(None, "x", 1.0), (5000, None, 1.0), (5001, "", 1.0), (1, rows[1][1], 2.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(a, c) for a, _, c in rows] + [(7777, 1), (None, 1), (3, None)], "doc_id long, quality int")
    net = quality.train(docs, labels)
    got = quality.score_quality(docs, net).collect()
    assert len(got) == docs.count()
    truth = {a: c for a, _, c in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 40 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    by_id = {r.doc_id: r.score for r in got}
    assert by_id[5000] == by_id[5001]
    kept = quality.keep_good(docs, net)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)
    assert quality.score_quality(docs.limit(0), net).count() == 0


def test_one_class_or_no_labels(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    for rows in ([], [(1, 1)]):
        net = quality.train(docs, spark.createDataFrame(rows, "doc_id long, quality int"))
        assert quality.score_quality(docs, net).first().predicted == 1


def plain_score(net, text):
    """The network on one text, one filter place after the other."""
    codes = list(text) + [256] * (-(-(len(text) + quality.WIDTH) // quality.CHUNK) * quality.CHUNK - len(text))
    taps = net.filters.reshape(quality.WIDTH * quality.DIM, quality.FILTERS)
    tops = []
    for begin in range(0, len(codes), quality.CHUNK):
        best = np.full(quality.FILTERS, -np.inf)
        for at in range(begin, begin + quality.CHUNK, quality.STRIDE):
            seen = codes[at : at + quality.WIDTH]
            if len(seen) == quality.WIDTH:
                best = np.maximum(best, net.embed[seen].ravel() @ taps)
        tops.append(np.maximum(best + net.bias, 0))
    z = np.concatenate((np.max(tops, axis=0), np.mean(tops, axis=0))) @ net.out + net.shift
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def test_scores_equal_a_plain_convolution(monkeypatch):
    monkeypatch.setattr(quality, "RUN_CHUNKS", 3)
    rng, net = random.Random(5), quality.fresh(4)
    texts = [b"", b"a", b"x" * 248, b"y" * 256] + [bytes(rng.choices(range(32, 250), k=rng.randint(1, 3000))) for _ in range(8)]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    assert np.allclose(quality.probabilities(net, np.frombuffer(b"".join(texts), np.uint8), offsets), [plain_score(net, t) for t in texts], atol=1e-4)


def test_training_does_not_depend_on_runs_and_reads_whole_texts(monkeypatch):
    rng = random.Random(6)
    texts, labels = [], []
    for k in range(120):
        words = rng.choices(["lamp", "river", "stone", "of", "the"], k=1500)
        if k % 2:
            for at in rng.sample(range(1500), 60):
                words[at] = "%%!~~"
        texts.append(" ".join(words).encode())
        labels.append(1.0 - k % 2)
    whole = quality.fit(texts[:90], np.array(labels[:90], np.float32), epochs=4)
    monkeypatch.setattr(quality, "RUN_CHUNKS", 7)
    again = quality.fit(texts[:90], np.array(labels[:90], np.float32), epochs=4)
    data, offsets = by.flat(pa.array([t.decode() for t in texts[90:]]))
    assert np.allclose(quality.probabilities(whole, data, offsets), quality.probabilities(again, data, offsets), atol=0.05)
    assert np.mean((quality.probabilities(whole, data, offsets) >= 0.3) == np.array(labels[90:])) > 0.9
