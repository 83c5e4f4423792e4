import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from inkgraph.llm import bytes as by
from inkgraph.llm import context_mixing as cm


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + ["\n"]


def invented(rng, n, size):
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 7))) for _ in range(n)]
    return lambda: " ".join(rng.choices(words, weights=range(1, n + 1), k=rng.randint(0, size)))


def some_model(lexicon_words, rng):
    counts = rng.integers(1, 50, len(lexicon_words))
    lexicon = cm.Lexicon.of(cm.word_hashes(pa.array([w.encode() for w in lexicon_words], pa.binary())), counts)
    by_symbol = np.zeros(len(counts) + 2, np.int64)
    by_symbol[lexicon.symbols] = lexicon.counts
    by_symbol[-2:] = 9, 7
    tree = cm.huffman(by_symbol)
    after = rng.integers(-200, 200, cm.CLASSES * len(tree.odds)).astype(np.int16)
    weights = rng.normal(0.4, 0.2, (42, 4)).astype(np.float32)
    return cm.Model(lexicon, tree, after, cm.huffman(rng.integers(0, 99, 256)), [rng.normal(0, 900, 1 << b).astype(np.int16) for b in cm.SLOT_BITS], weights)


def plain_log_probability(model, text, codes):
    """One bit at a time. codes: what is decided of the text's contexts, by the pair of tokens before."""
    data, offsets = by.flat(pa.array([text]))
    t = cm.Tokens.of(data, offsets)
    symbol, before = model.lexicon.coded(t)
    spelt = [model_word.encode() for model_word in tokens(text)]
    events, last, own_bits = [], {}, defaultdict(lambda: [0, 0])
    matched = 0
    for k, word in enumerate(spelt):
        pair, hit = tuple(spelt[max(0, k - 2) : k]), 0
        if len(pair) == 2:
            gate = None
            if pair in last:
                run, follower = last[pair]
                hit = int(follower == word)
                gate, odds = cm._OWN_GATE + 2 * (min(run, 3) - 1), 0.0
                last[pair] = (run + 1, word)
            else:
                last[pair] = (1, word)
                if codes.get(pair):
                    code = codes[pair] - 1
                    hit = code % 2
                    step = code // 2
                    gate, odds = cm._FAR_GATE + 4 * (step % 3) + 2 * (step // 3 % 2), (step // 6 - 3.5) * math.log(2)
            if gate is not None:
                events.append((gate + matched, hit, [odds, 0, 0, 1.0]))
        matched = hit
        if hit:
            continue

        def seen(key, bit):
            zeros, ones = own_bits[key]
            own_bits[key][bit] += 1
            return math.log((min(ones, 63) + 0.4) / (min(zeros, 63) + 0.4)), min(2, zeros + ones)

        for place in range(model.tree.first[symbol[k]], model.tree.first[symbol[k] + 1]):
            node, bit = int(model.tree.nodes[place]), int(model.tree.bits[place])
            behind = int(model.after[before[k] * len(model.tree.odds) + node])
            own, many = seen(node, bit)
            events.append((many * 4 + behind % 4, bit, [model.tree.odds[node], (behind - behind % 4) / 4 * 0.05, own, 0.3]))
        if symbol[k] == len(model.lexicon.hashes):
            raw = np.frombuffer(word + b" ", np.uint8)
            bits, reps, slots, _ = cm.spelt_events(model.letters, raw, np.zeros(len(raw), np.int64))
            at = 0
            for j, byte in enumerate(raw.tolist()):
                for i in range(reps[j]):
                    bit = int(bits[at])
                    far, near = (model.spelt[q][slots[q][at]] / 1024 for q in (0, 1))
                    own, many = seen((word[:j], byte >> 8, int(model.letters.nodes[model.letters.first[byte] + i])), bit)
                    events.append((12 + many * 4 + min(3, int(abs(near))), bit, [far, near, own, 0.3]))
                    at += 1
    total, own = 0.0, np.zeros((2, 4))
    for at, size in cm.blocks(len(events)):
        part = events[at : at + size]
        slope = np.zeros((2, 4))
        for gate, bit, x in part:
            match = int(gate >= cm._OWN_GATE)
            z = float(np.clip(np.dot(model.weights[gate] + own[match], x), -14, 14))
            one = 1 / (1 + math.exp(-z))
            total += math.log(one if bit else 1 - one)
            slope[match] += (bit - one) * np.array(x)
        own[0] += np.clip(cm.RATE * slope[0], -0.2, 0.2)
        own[1] += np.clip(4 * cm.RATE * slope[1], -0.5, 0.5)
        own = np.clip(own, -3, 3)
    return total


def test_scores_equal_a_plain_loop_over_bits():
    rng, nprng = random.Random(5), np.random.default_rng(6)
    text = invented(rng, 60, 400)
    texts = [text() for _ in range(12)] + ["", "One", "é x é x é x", None, "new words " * 300]
    model = some_model(sorted({w for x in texts[:6] for w in tokens(x)[:-1]})[::2], nprng)
    g = cm.Group.of(pa.array(texts), model.lexicon, 40)
    codes = nprng.integers(0, 98, g.first.sum()).astype(np.uint8)
    got = cm.log_probabilities(model, g, codes)
    of = [dict() for _ in texts]
    for code, at in zip(codes.tolist(), g.at[g.first].tolist()):
        own = [w.encode() for w in tokens(texts[g.tokens.text[at]])]
        k = int(g.tokens.place[at])
        of[g.tokens.text[at]][tuple(own[k - 2 : k])] = code
    want = [plain_log_probability(model, x, c) for x, c in zip(texts, of)]
    assert np.allclose(got, want, rtol=2e-4, atol=1e-2)
    for k in (0, 7, 16):  # a score does not depend on the texts beside it
        alone = cm.Group.of(pa.array([texts[k]]), model.lexicon, 40)
        own = codes[g.tokens.text[g.at[g.first]] == k]
        assert cm.log_probabilities(model, alone, own)[0] == pytest.approx(got[k], rel=1e-4)


def test_bits_have_probabilities_that_sum_to_one():
    rng = np.random.default_rng(3)
    x, gate = [rng.normal(0, 2, 900).astype(np.float32) for _ in range(3)], rng.integers(0, 42, 900).astype(np.int8)
    bit, weights = rng.integers(0, 2, 900).astype(np.uint8), rng.normal(0.3, 0.2, (42, 4)).astype(np.float32)
    for k in (0, 100, 127, 128, 500, 899):
        other = bit.copy()
        other[k] ^= 1
        before = cm.mixed_bits(weights, cm.Events(x, gate, bit, np.arange(900), np.array([0, k])))[0] if k else 0.0
        both = [math.exp(cm.mixed_bits(weights, cm.Events(x, gate, b, np.arange(900), np.array([0, k + 1])))[0] - before) for b in (bit, other)]
        assert sum(both) == pytest.approx(1.0, abs=1e-3)
    for tree in (cm.huffman(rng.integers(0, 1000, 256)), cm.huffman(np.array([0, 0]))):  # the codes are complete
        assert sum(2.0 ** -float(n) for n in np.diff(tree.first)) == pytest.approx(1.0)


def test_what_other_texts_say_against_brute_force():
    rng = np.random.default_rng(4)
    for top in (6, 1 << 45):
        context, after, learnt = rng.integers(0, 6, 400).astype(np.uint64) * np.uint64(top // 6), rng.integers(1, 9, 400), rng.random(400) < 0.6
        got = cm.decided(context, after, learnt)
        for k in range(400):
            others = Counter(int(a) for j, (c, a, y) in enumerate(zip(context, after, learnt)) if y and j != k and c == context[k])
            if not others:
                assert got[k] == 0
                continue
            best = min(others, key=lambda w: (-others[w], w))
            assert got[k] == 1 + (best == after[k]) + 2 * cm.strength(np.array([others[best]]), np.array([sum(others.values())]))[0]


def brute(rows):
    held = {a: zlib.crc32(("" if a is None else str(a)).encode()) % 7 == 2 for a, _ in rows}
    counts = Counter(t for a, b in rows if not held[a] for t in tokens(b))
    n, v = sum(counts.values()), len(counts)
    return sorted(((a, held[a], len(tokens(b)), sum(counts[t] > 0 for t in tokens(b)), n, round(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens(b)), 6)) for a, b in rows), key=str)


@pytest.mark.parametrize("common", [20, 1000])
def test_counts_and_base_against_brute_force(spark, monkeypatch, common):
    monkeypatch.setattr(cm, "COMMON", common)
    monkeypatch.setattr(cm, "GROUP_TOKENS", 1500)
    monkeypatch.setattr(cm, "PART_TOKENS", 4000)
    rng = random.Random(9)
    text = invented(rng, 120, 80)
    rows = [(k, text()) for k in range(150)]
    rows += [(None, "null id"), (500, None), (501, ""), (3, rows[3][1]), (3, "other text"), (502, "new " * 3000)]
    df = spark.createDataFrame([(a, b, 1.0) for a, b in rows], "doc_id long, text string, score double")
    got = cm.score_texts(df).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == brute(rows)
    assert all(r.score < 0 and r.bits_per_byte > 0 for r in got)
    again = cm.score_texts(df.repartition(5)).collect()
    assert sorted((str(r.doc_id), round(r.score, 3)) for r in again) == sorted((str(r.doc_id), round(r.score, 3)) for r in got)
    assert cm.score_texts(df.limit(0)).count() == 0


def test_copies_are_told_apart_and_word_order_counts(spark):
    rng = random.Random(2)
    text = invented(rng, 300, 150)
    texts = [text() + " " + text() for _ in range(260)]
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in range(2000)}
    pairs = [k for k in range(60) if not held[k] and not held[1000 + k]]
    order = " ".join(sorted(texts[pairs[0]].split()))
    rows = list(enumerate(texts)) + [(1000 + k, texts[k]) for k in range(0, 60)] + [(5000, order)]
    got = {r.doc_id: r for r in cm.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}

    def gain(k):
        return (got[k].score - got[k].base_score) / got[k].n_tokens

    single = [gain(k) for k in range(60, 260)]
    assert min(gain(k) for k in pairs) > max(single)
    unlearnt = [k for k in range(60) if held[k] and not held[1000 + k]]
    assert unlearnt and min(gain(k) for k in unlearnt) > max(single)
    assert got[5000].score < got[pairs[0]].score - 10 and got[5000].base_score == pytest.approx(got[pairs[0]].base_score)


def test_pairs_of_class_and_symbol_come_from_every_text():
    texts = ["b a b c", "", "a b a b x y", "c b a", "only here"] * 40
    words = cm.Tokens.of(*cm.by.flat(pa.array(texts))).words
    hashes, counts = np.unique(words.hashes, return_counts=True)
    lexicon = cm.Lexicon.of(hashes[:3], counts[:3])
    batches = [pa.RecordBatch.from_arrays([pa.array(part)], names=["_text"]) for part in (texts[:7], texts[7:])]
    got = {k: c for out in cm._pairs(iter(batches), lexicon) for k, c in zip(*(x.to_pylist() for x in out.columns))}
    symbol, before = lexicon.coded(cm.Tokens.of(*cm.by.flat(pa.array(texts))))
    assert got == dict(Counter((before * 5 + symbol).tolist()))
    assert (cm.first_weights() == cm.first_weights()).all() and cm.first_weights().shape == (cm._GATES, cm._INPUTS)


def test_words_are_found_from_their_first_bits():
    rng = np.random.default_rng(8)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    crowded = (np.uint64(5) << np.uint64(60)) + np.arange(40, dtype=np.uint64) * np.uint64(3)  # no first bits tell these apart
    for own in (np.concatenate((crowded, rng.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2), np.array([0, top], np.uint64))), crowded, np.array([7], np.uint64), np.array([top])):
        lexicon = cm.Lexicon.of(np.unique(own), np.arange(1, len(np.unique(own)) + 1))
        assert len(lexicon.begins[1]) >= 2 * len(lexicon.hashes)
        asked = np.concatenate((own, own + np.uint64(1), own - np.uint64(1), rng.integers(0, 1 << 63, 500, dtype=np.uint64), np.array([0, top], np.uint64)))
        at, hit = lexicon.find(asked)
        assert (hit == np.isin(asked, own)).all() and (lexicon.hashes[at[hit]] == asked[hit]).all()
    assert not cm.Lexicon.of(own[:0], np.zeros(0, np.int64)).find(own)[1].any()


def test_nearly_sure_bits_keep_their_small_costs():
    n = 100  # one block: no refinement
    z = np.linspace(8, 13.5, n).astype(np.float32)
    weights = np.zeros((42, 4), np.float32)
    weights[:, 0] = 1
    e = cm.Events([z, np.zeros(n, np.float32), np.zeros(n, np.float32)], np.zeros(n, np.int8), np.ones(n, np.uint8), np.arange(n), np.array([0, n]))
    assert cm.mixed_bits(weights, e)[0] == pytest.approx(-np.log1p(np.exp(-z.astype(np.float64))).sum(), rel=1e-4)


def test_distinct_hashes_equal_a_plain_count():
    rng = np.random.default_rng(12)
    for hashes in (rng.integers(0, 1 << 63, 500, dtype=np.uint64)[rng.integers(0, 500, 3000)], rng.integers(0, 9, 300).astype(np.uint64), np.array([3], np.uint64)):  # the second lot differ in their last bits alone
        _, first, count = np.unique(hashes, return_index=True, return_counts=True)
        assert [x.tolist() for x in cm.distinct(hashes)] == [first.tolist(), count.tolist()]
    every = np.arange(256, dtype=np.uint8)
    assert (by.Words(every, np.array([0, 256])).low == by.LOWER).all()
    alone = np.stack((every, np.full(256, 32, np.uint8)), axis=1).ravel()
    assert (by.Words(alone, np.arange(0, 513, 2)).counts == ~by.SPACE).all()
