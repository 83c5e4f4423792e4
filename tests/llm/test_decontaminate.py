import random
import re
from collections import Counter

import pyarrow as pa

from inkgraph.llm import decontaminate as de


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def bag(words, size):
    return [tuple(words[k : k + size]) for k in range(len(words) - size + 1)] if len(words) >= size else [tuple(words)]


def brute(docs, items, size=5, percent=80):
    out = []
    for doc, text in docs:
        w = tokens(text)
        for item, passage in items:
            p = tokens(passage)
            if not w or not p:
                continue
            best = 0
            if len(p) < size:
                best = float(any(w[k : k + len(p)] == p for k in range(len(w) - len(p) + 1)))
            elif len(w) >= size:
                want = Counter(bag(p, size))
                for k in range(max(1, len(w) - len(p) + 1)):
                    have = Counter(bag(w[k : k + len(p)], size))
                    best = max(best, sum((want & have).values()) / sum((want | have).values()))
            if best >= percent / 100 - 1e-9:
                out.append((doc, item, round(best, 9)))
    return sorted(out, key=str)


def test_leaks_against_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([3, 5, 6, 14, 40, 60])))) for k in range(25)] + [(90, None), (91, " "), (None, "null id " + " ".join(rng.choices(words, k=20)))]
    docs = []
    for k in range(60):
        text = rng.choices(words, k=rng.choice([0, 3, 10, 50, 300]))
        for _ in range(rng.randint(0, 2)):
            passage = (rng.choice(items)[1] or "").split(" ")
            for _ in range(rng.randint(0, 2)):
                passage[rng.randrange(len(passage))] = "changed"
            if rng.random() < 0.3:
                passage = passage[: len(passage) * 9 // 10]
            at = rng.randrange(len(text) + 1)
            text[at:at] = passage
        docs.append((k, (" ".join(text)).upper() if k % 2 else "\n".join(text)))
    docs += [(500, None), (None, items[3][1]), (3, docs[3][1]), (501, items[5][1] + " " + "filler " * 2000)]
    df = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert len(want) > 15
    got = sorted([(r.doc_id, r.item_id, r.similarity) for r in de.find_leaks(df, bench).collect()], key=str)
    assert got == want
    monkeypatch.setattr(de, "ITEMS", 7)
    again = sorted([(r.doc_id, r.item_id, r.similarity) for r in de.find_leaks(df, bench).collect()], key=str)
    assert again == want
    monkeypatch.setattr(de, "ITEMS", 20_000)
    monkeypatch.setattr(de, "ITEM_BYTES", 1500)
    assert len(list(de.indexes(bench, 5))) > 2
    assert sorted([(r.doc_id, r.item_id, r.similarity) for r in de.find_leaks(df, bench).collect()], key=str) == want
    kept = de.without_leaks(df, bench)
    assert kept.columns == df.columns
    rows = sum(len(brute([d], items)) > 0 for d in docs)
    assert kept.count() == len(docs) - rows
    assert de.find_leaks(df.limit(0), bench).count() == 0 and de.find_leaks(df, bench.limit(0)).count() == 0
    assert de.without_leaks(df, bench.limit(0)).count() == len(docs)


def test_windows_of_a_long_text_go_through_in_runs(monkeypatch):
    rng = random.Random(12)
    item = " ".join("".join(rng.choices("abcdef", k=5)) for _ in range(60))
    text = " ".join([item] * 40 + ["filler words here"] * 50 + [item])
    index = de.build([(1, item)], 5)
    whole = de.leaks(index, pa.array([text]), 5, 80)
    monkeypatch.setattr(de, "RUN_BYTES", 64 * 56 * 7)
    assert de.leaks(index, pa.array([text]), 5, 80) == whole and len(whole) == 1
