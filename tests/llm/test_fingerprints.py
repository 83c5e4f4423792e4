import hashlib
import random

import numpy as np

from inkgraph.llm.fingerprints import compared, differing, digests, edited_text, fingerprint_likeness, fingerprint_versions, likeness, stored


def test_peeling_recovers_the_differing_digests():
    rng = random.Random(3)
    left, right = [], []
    for n in [0, 1, 2, 5, 20, 80, 400, 3000]:
        common = [rng.getrandbits(64) for _ in range(n)]
        left.append(np.array(common + [rng.getrandbits(64) for _ in range(rng.randint(0, n))], dtype=np.uint64))
        right.append(np.array(common + [rng.getrandbits(64) for _ in range(rng.randint(0, n))], dtype=np.uint64))
    got, size = differing(left, right)
    for (a, b), x, y in zip(got, left, right):
        assert sorted(a) == sorted(set(x) - set(y)) and sorted(b) == sorted(set(y) - set(x))
    assert size[-1] > size[0]


def test_repeated_paragraphs_count():
    a, b = digests("x\nx\ny"), digests("x\ny")
    assert likeness([a], [b], stored([a]), stored([b]))[0] == 1 - 1 / 5
    assert stored([a]) != stored([b]) and stored([a]) == stored([digests("x\nx\ny")])


def brute(rows):
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1] or ""))
    out = []
    for k, (doc, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        edited = edited_text(text, after)

        def near(x, y):
            x, y = set(digests(x).tolist()), set(digests(y).tolist())
            return 1 - len(x ^ y) / (len(x) + len(y)) if x or y else 1.0

        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), round(near(text, edited), 9), round(near(text, after), 9)))
    return sorted(out, key=str)


def test_versions_against_brute_force(spark):
    rng = random.Random(5)
    words = ["alpha", "beta.", "gamma", "dé\n", "日本", "x!"]
    rows = [(k * 3 % 101, " ".join(rng.choices(words, k=rng.randint(0, 200)))) for k in range(90)]
    rows += [(None, "none"), (7, None), (7, "again"), (7, "again"), (200, "long " * 20000)]
    for part in (rows, rows[:1], [(None, None)]):
        df = spark.createDataFrame([(a, b, "s") for a, b in part], "doc_id long, text string, fingerprint string")
        got = fingerprint_versions(df, buckets=7).collect()
        assert sorted(((r[0], r[1], r[2], round(r[5], 9), round(r[6], 9)) for r in got), key=str) == brute(part)
    assert fingerprint_versions(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_stored_fingerprints_alone_tell_what_differs(spark):
    rng = random.Random(9)
    common = [rng.getrandbits(64) for _ in range(70000)]
    sets = [np.array(x, dtype=np.uint64) for x in (common, common[3:] + [5, 7], [], common[:60], common[1000:1100])]
    prints = stored(sets)
    parts, total = compared([prints[k] for k in (0, 0, 2, 3)], [prints[k] for k in (0, 1, 2, 4)])
    assert [len(x) for x in parts[0]] == [0, 0] == [len(x) for x in parts[2]]
    assert sorted(parts[1][0]) == sorted(common[:3]) and sorted(parts[1][1]) == [5, 7]
    assert parts[3] is None and list(total) == [140000, 139999, 0, 160]
    df = spark.createDataFrame([(0, prints[0], prints[1]), (1, prints[3], prints[4]), (2, prints[2], prints[2]), (3, None, prints[0])], "k int, a string, b string")
    got = {r.k: r.near for r in df.select("k", fingerprint_likeness("a", "b").alias("near")).collect()}
    assert got == {0: 1 - 5 / 139999, 1: None, 2: 1.0, 3: None}


def test_near_columns_follow_from_the_stored_fingerprints(spark):
    df = spark.createDataFrame([(k, "\n".join(f"line {j}" for j in range(k % 30 + 6))) for k in range(40)], "doc_id long, text string")
    rows = fingerprint_versions(df, buckets=3).withColumn("near", fingerprint_likeness("fingerprint", "edited_fingerprint")).collect()
    peeled = [r for r in rows if r.near is not None]
    assert len(peeled) > 5 and all(abs(r.near - r.near_edited) < 1e-12 for r in peeled)
