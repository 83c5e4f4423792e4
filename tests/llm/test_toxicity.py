import random

import numpy as np
import pyarrow as pa

from inkgraph.llm import bytes as by
from inkgraph.llm import toxicity


def test_windows_cover_every_word():
    texts = ["", " ", "a", "a b c d e f g", "x " * 100, None, "tail"]
    words = by.Words(*by.flat(pa.array(texts)))
    first, last, text = toxicity.windows(words)
    covered = {w for a, b in zip(first, last) for w in range(a, b)}
    assert covered == set(range(len(words.first)))
    owner = words.owner()
    assert all(owner[a] == t and owner[b - 1] == t for a, b, t in zip(first, last, text))


def test_grams_are_those_of_padded_words():
    words = by.Words(*by.flat(pa.array(["Abcd é", "abcd"])))
    bucket, owner = toxicity.grams(words, 0, 3)
    same = [sorted(bucket[owner == k].tolist()) for k in (0, 2)]
    assert same[0] == same[1]  # case and place do not matter
    assert len(same[0]) == 1 + sum(4 + 2 - n + 1 for n in toxicity.GRAMS)


def test_held_out_and_misspelt(spark):
    rng = random.Random(4)
    plain = ["".join(rng.choices("aeioulmnrst", k=rng.randint(2, 8))) for _ in range(300)]
    bad = ["dreadfulbeast", "horridfool", "nastycreature"]
    rows = []
    for k in range(900):
        words = rng.choices(plain, k=rng.randint(5, 80))
        toxic = k % 4 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((k, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([(a, b, "clash") for a, b, _ in rows] + [(None, "x", ""), (5000, None, ""), (5001, "", ""), (5002, " \n", ""), (5003, plain[0] + " horridfoool " + plain[1], ""), (4, rows[4][1], "")], "doc_id long, text string, score string")
    model = toxicity.train(docs, spark.createDataFrame([(a, c) for a, _, c in rows], "doc_id long, toxic int"))
    got = toxicity.score_toxicity(docs, model).collect()
    assert len(got) == docs.count()
    truth = {a: c for a, _, c in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.9
    score = {r.doc_id: r.score for r in got}
    assert score[5000] == score[5001] == score[5002] < 0.5
    assert score[5003] > 0.5
    assert toxicity.keep_civil(docs, model).count() == sum(1 - r.predicted for r in got)
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def plain_score(model, text):
    """The most toxic window, one n-gram after the other."""
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    best = -np.inf if words else 0.0
    for first in range(0, max(1, len(words) - toxicity.WINDOW + toxicity.HOP), toxicity.HOP) if words else ():
        values = []
        for word in words[first : first + toxicity.WINDOW]:
            own = by.Words(np.frombuffer(word, np.uint8), np.array([0, len(word)]))
            padded = b" " + word + b" "
            pieces = [padded[k : k + n] for n in toxicity.GRAMS for k in range(len(padded) - n + 1)]
            data = np.frombuffer(b"".join(pieces), np.uint8)
            ends = np.cumsum([len(p) for p in pieces])
            hashes = by.span_hash(by.prefix_hash(data), ends - [len(p) for p in pieces], ends) if pieces else np.zeros(0, np.uint64)
            values += model.value[(np.concatenate((own.hashes, hashes)) >> toxicity._SHIFT).astype(int)].tolist()
        best = max(best, float(np.mean(values)))
    return 1 / (1 + np.exp(-np.clip(best + model.bias, -30, 30)))


def test_scores_equal_a_plain_loop_over_windows(monkeypatch):
    monkeypatch.setattr(toxicity, "RUN_WORDS", 50)
    rng = random.Random(8)
    model = toxicity.Model(np.random.default_rng(1).normal(0, 3, toxicity.BUCKETS), -1.5)
    texts = ["", " ", "A", "é x"] + [" ".join("".join(rng.choices("abcXYé", k=rng.randint(1, 9))) for _ in range(rng.randint(1, 400))) for _ in range(12)]
    assert np.allclose(toxicity.probabilities(model, *by.flat(pa.array(texts))), [plain_score(model, t) for t in texts])


def test_learns_from_all_of_a_long_text(spark):
    rng = random.Random(7)
    plain = ["".join(rng.choices("aeioulmnrst", k=rng.randint(2, 8))) for _ in range(400)]
    rows = []
    for k in range(240):
        words = rng.choices(plain, k=8000)  # some 50 kB
        if k % 3 == 0:
            words[rng.randrange(8000)] = "vilewretch"
        rows.append((k, " ".join(words), int(k % 3 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(8)
    model = toxicity.train(docs, spark.createDataFrame([(a, c) for a, _, c in rows], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    held = [k for k in got if got[k].held_out]
    assert len(held) > 25 and np.mean([got[k].predicted == rows[k][2] for k in held]) > 0.9


def test_a_repeated_labelled_document_counts_once(spark):
    docs = spark.createDataFrame([(k, f"text {k} {j}") for k in range(20) for j in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)] + [(2, 1)], "doc_id long, toxic int")
    got = toxicity.labelled_sample(docs, labels, "toxic", 5, (5, 50)).collect()
    ids = [r.doc_id for r in got]
    assert len(ids) == len(set(ids)) and sum(r.label == 0 for r in got) == 5 and all(r.label == 1 for r in got if r.doc_id == 2)
