import re
import zlib
from collections import Counter

import numpy as np
import pytest

from inkgraph.llm import spelling as s

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def counted(docs):
    out = Counter()
    for i, text in docs:
        for run in RUN.findall(text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            out[w[: h % len(w)] + w[h % len(w) + 1:] if h % 31 == 0 else w] += 1
    return {w: n for w, n in out.items() if n >= 2 and len(w) >= 7}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain(docs):
    n = counted(docs)
    forms, count = {}, {}
    for w in n:
        others = [x for x in n if near(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        forms[w], count[w] = (best if best and n[best] >= 10 * n[w] else None), len(others)
    def root(w):
        return w if forms[w] is None else root(forms[w])
    return sorted((w, forms[w] or "", root(w), n[w], count[w], n[forms[w]] if forms[w] else -1) for w in n)


def got(rows):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in rows)


def fixture():
    rng = np.random.default_rng(11)
    syllables = ["an", "to", "re", "is", "çü", "no", "é", "st", "a"]
    words = ["".join(rng.choice(syllables, rng.integers(3, 6))) for _ in range(300)]
    docs = [(int(i), " ".join(rng.choice(words, 40)) + ". " + " ".join(w.upper() for w in rng.choice(words, 10))) for i in range(120)]
    ladder = [("windows", 2000), ("windowz", 180), ("windowzy", 17), ("windowzyx", 2)]
    docs += [(1000 + k, (w + "-") * n) for k, (w, n) in enumerate(ladder)]
    long = "ab" * 2000
    docs += [(None, "Missing missing missing"), (5, None), (6, ""), (7, "short words"), (2000, f"{long} {long} {long}x {long}x b{long[1:]} b{long[1:]}"), docs[3], docs[3], (2001, "ÀBCDEFG àbcdefg ÀBCDEFG àbcdefg ×÷×÷×÷× ×÷×÷×÷×")]
    return docs


@pytest.mark.parametrize("part", [s.PART, 20])
def test_against_plain_version(spark, part):
    docs = fixture()
    d = spark.createDataFrame([(*x, "w", 1) for x in docs], "doc_id long, text string, word string, n int").repartition(5)
    want = plain(docs)
    assert got(s.group_variants(d, part=part).collect()) == want
    assert any(r[2] != r[1] != "" for r in want) and sum(r[4] for r in want) >= 50


def test_counts_of_many_batches_are_summed(spark, monkeypatch):
    docs = fixture()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert {r.word: r.n for r in s.count_words(d).collect()} == counted(docs)


def test_boxes_find_all_pairs():
    rng = np.random.default_rng(2)
    words = sorted({"".join(rng.choice(list("abcé"), n)) for n in (7, 8) for _ in range(900)})
    i, j = s.near_pairs(words, 7)
    pairs = sorted(tuple(sorted((words[a], words[b]))) for a, b in zip(i, j))
    assert len(pairs) == len(set(pairs))
    assert pairs == sorted((a, b) for x, a in enumerate(words) for b in words[x + 1:] if max(len(a), len(b)) == 8 and near(a, b))


def test_no_rows(spark):
    assert s.group_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
