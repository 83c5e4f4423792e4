import math
import re
from collections import Counter

import numpy as np

from inkgraph.llm import ranked_search as r

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain(docs, items, most):
    split = lambda t: TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    bags = [(i, Counter(split(t))) for i, t in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item in {i for i, _ in items if i is not None}:
        own = {t for i, text in items if i == item for t in split(text)}
        rows = []
        for i, b in bags:
            score = 0
            for t in own & set(b):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                m = 100 - 50 + (50 * sum(b.values()) * n_docs) // total
                score += w * ((1_000_000_000 * b[t]) // (1000 * b[t] + 20 * m))
            if score > 0:
                rows.append((-score, i is None, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(rows, key=lambda x: (x[0], x[1], x[2] or 0))[:most])]
    return sorted(out, key=str)


WORDS = ["alpha", "beta", "a", "b", "ab", "gamma", "Über", "x1", "1", "’", "naïve", " ", "\U0001f600"]


def tables():
    rng = np.random.default_rng(5)
    text = lambda n: "".join(str(rng.choice(WORDS)) + str(rng.choice([" ", ", ", ".\n", "--", "_", "\x00"])) for _ in range(n))
    docs = [(int(i), text(int(rng.integers(1, 40)))) for i in range(300)]
    docs += [(7, docs[7][1]), (None, docs[8][1]), (None, None), (400, ""), (401, " .,;"), (402, None), (403, "ALPHA Alpha alphabet"), (404, "beta " * 50_000), *[(500 + i, "gamma ab") for i in range(30)]]
    items = [(1, "Alpha beta"), (2, "gamma! ab"), (3, ""), (4, None), (5, "absent"), (6, "a b 1 x1 Über über"), (2, "naïve ’"), (None, "alpha"), (8, "  \U0001f600")]
    return docs, items


def test_against_plain_ranking(spark):
    docs, items = tables()
    d = spark.createDataFrame([(*x, "k", 1) for x in docs], "doc_id long, text string, rank string, item int").repartition(7)
    i = spark.createDataFrame([(*x, "k") for x in items], "item_id long, text string, doc_id string")
    want = plain(docs, items, 20)
    for limit in (r.BLOCK_BYTES, 12):
        assert sorted(map(tuple, r.rank_documents(d, i, 20, block_bytes=limit).collect()), key=str) == want


def test_best_rows_are_kept_through_many_rounds(monkeypatch):
    monkeypatch.setattr(r, "CELLS", 64)
    rng = np.random.default_rng(3)
    table, ids = rng.integers(0, 6, (500, 4)), rng.permutation(500)
    best = r.Best(4, 5)
    for k in range(0, 500, 10):
        best.add(table[k:k + 10], ids[k:k + 10])
    got = sorted(zip(*(x.tolist() for x in best.settle())))
    want = sorted((k, int(s), int(i)) for k in range(4) for s, i in sorted(zip(table[:, k], ids), key=lambda x: (-x[0], x[1]))[:5])
    assert got == want


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    i = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert r.rank_documents(d, i).count() == 0
    assert r.rank_documents(i.withColumnRenamed("item_id", "doc_id"), i.limit(0)).count() == 0
