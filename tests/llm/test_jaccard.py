import random
import re

import numpy as np
import pytest

from inkgraph.llm import jaccard


def brute(rows, size, percent):
    sets = []
    for _, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            o = len(sets[a] & sets[b])
            if sets[a] and 100 * o >= percent * (len(sets[a]) + len(sets[b]) - o) and o:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    least = {}
    for k, (doc, _) in enumerate(rows):
        least.setdefault(find(k), []).append(doc)
    out = []
    for k, (doc, _) in enumerate(rows):
        ids = [x for x in least[find(k)] if x is not None]
        out.append((doc, len(sets[k]), (min(ids) if ids else None) if sets[k] else doc, links[k]))
    return sorted(out, key=str)


def corpus(seed, families=25):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = rng.choices(words, k=60)
    rows, doc = [], 0
    for f in range(families):
        base = rng.choices(words, k=rng.choice([1, 2, 3, 5, 8, 20, 60, 200]))
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                text[rng.randrange(len(text))] = rng.choice(words)
            if f % 3 == 0:
                at = rng.randrange(len(text) + 1)
                text[at:at] = passage
            rows.append((doc * 7 % 1009, (" " if doc % 2 else "\n").join(text).upper() if doc % 5 == 0 else " ".join(text)))
            doc += 1
    return rows


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80)])
def test_classes_against_all_pairs(spark, size, percent, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 3)
    rows = corpus(size) + [(3000, None), (3001, ""), (3002, " \n"), (None, "w1 w2 w3 w4 w5"), (3003, "w1 w2 w3 w4 w5"), (None, "lonely one"), (0, "again another text here now"), (3004, "long " * 3000 + "tail"), (3005, "long " * 2500 + "tail")]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, sid int")
    got = sorted([(r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in jaccard.link_classes(df, size, percent).collect()], key=str)
    want = brute(rows, size, percent)
    assert got == want
    assert len({x[2] for x in want}) < len(rows) - 10
    kept = jaccard.one_of_each(df, size, percent)
    assert kept.columns == df.columns


def test_pairs_of_a_tile_are_all_counted():
    rng = np.random.default_rng(2)
    pool = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
    sets = [np.unique(np.delete(pool, rng.choice(300, rng.integers(0, 40), replace=False))) for _ in range(70)]
    copies, side, sids = rng.integers(1, 5, 70), rng.integers(0, 2, 70), np.arange(70) * 10
    for cross in (False, True):
        linked = {(a, b) for a in range(70) for b in range(70) if a != b and (not cross or side[a] != side[b]) and 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))}
        want = {a * 10: int(sum(copies[b] for x, b in linked if x == a)) for a in {a for a, _ in linked}}
        forest, totals = jaccard.links_in_tile(sids, sets, side, cross, 85, copies)
        assert totals == want and len(linked) > 500
        plain, none = jaccard.links_in_tile(sids, sets, side, cross, 85)
        assert len(plain) == len(forest) and not none
        assert {(a // 10, b // 10) for a, b in forest} <= linked


def test_bound_is_never_below_the_overlap():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool, rng.integers(1, 300))) for _ in range(60)]
    maps = jaccard.bitmaps(sets, 512)
    for a in range(60):
        for b in range(60):
            apart = int(np.bitwise_count(maps[a] ^ maps[b]).sum())
            assert (len(sets[a]) + len(sets[b]) - apart) // 2 >= len(np.intersect1d(sets[a], sets[b]))


def test_no_rows(spark):
    assert jaccard.link_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
