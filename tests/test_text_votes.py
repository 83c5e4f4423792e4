import random

import numpy as np
from pyspark.sql import functions as F

from inkgraph.operators import annotations, text_votes, tokens, voting
from inkgraph.operators.cutting import whole_documents
from inkgraph.plans import registry

ODD = ["The quickly-running analysis, of well-known (x1) 3,4 12  tests_and_more.", "", None, "-" * 70 + " a--b " + ".a" * 30, "\U0001F600né  x İstanbuled Ünited ²³ ٣ ⅷ 一 _", "to\tto\x0bto\x1cto\x85to", "word " * 300, "éd bed́ ﬁed"]


def _docs(spark):
    rng = random.Random(7)
    texts = [*ODD, *("".join(rng.choice("ab-_.,( \n1é") for _ in range(rng.randrange(90))) for _ in range(60))]
    # a document of two rows, and rows without a document
    rows = [*enumerate(texts), (3, ".a" * 9 + " ab-c"), (0, "The quick"), (None, "ab ab"), (None, "ab c-d")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def _same(a, b):
    assert a.columns == b.columns and [f.dataType for f in a.schema] == [f.dataType for f in b.schema]
    rows = [sorted(map(str, x.collect())) for x in (a, b)]
    assert rows[0] == rows[1] and rows[0]


def test_votes_of_texts_equal_votes_of_their_tokens(spark):
    docs = _docs(spark)
    clustered = voting.cluster_tokens(tokens.tagged(tokens.tokenize(docs)))
    _same(text_votes.vote_texts(docs).drop("stands"), voting.vote_tokens(clustered))
    _same(text_votes.merge_texts(docs).where("doc_id IS NOT NULL"), voting.merge_tokens(clustered))
    single = docs.dropDuplicates(["doc_id"])
    _same(annotations.from_votes(text_votes.vote_texts(single), single), annotations.from_votes(voting.vote_tokens(voting.cluster_tokens(tokens.tagged(tokens.tokenize(single)))), single))


def test_no_token_is_shuffled_for_a_vote(spark, tmp_path):
    _docs(spark).dropDuplicates(["doc_id"]).withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text")}).write.parquet(f"{tmp_path}/documents.parquet")
    for name, exchanges in (("vote_tokens", 1), ("vote_agreement_rate", 2), ("vote_merge_tokens", 2), ("annotations_from_votes", 2)):
        plan = registry.queries()[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        # texts alone are dealt, and what is counted in the end
        assert plan.count("Exchange") == exchanges and "Window" not in plan and "Join" not in plan


def test_clusters_of_many_spans(spark):
    rng = np.random.default_rng(3)
    start = rng.integers(0, 60, 800)
    spans = sorted(zip(start.tolist(), (start + rng.integers(1, 40, 800)).tolist()))
    spans = [(a + 200 * (k % 2), b + 200 * (k % 2)) for k, (a, b) in enumerate(spans)]
    spans = sorted({*spans, *((k, k + 1) for k in range(300, 420)), (300, 420)})
    a, b = (np.array(x) for x in zip(*spans))
    island, number = text_votes.seed_clusters(a, b, 0.5)
    rows = spark.createDataFrame([(1, "p", k, "", x, y, "X", 0.5) for k, (x, y) in enumerate(spans)], "doc_id int, processor string, idx int, text string, start long, end long, pos string, confidence double")
    want = {(r.start, r.end): r.cluster for r in voting.cluster_tokens(rows).collect()}
    assert {s: f"{i + 1}.{n}" for s, i, n in zip(spans, island.tolist(), number.tolist())} == want and number.max() > text_votes.ROUNDS


def test_documents_stay_whole_in_a_step():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"doc_id": ids, "text": texts}) for ids, texts in (([1, 1, 2], ["aaa", "b", None]), ([2, 3], ["cc", "d"]))]
    assert [(a.to_pylist(), b) for a, b in whole_documents(iter(batches), 2)] == [([1, 1], ["aaa", "b"]), ([2, 2], ["", "cc"]), ([3], ["d"])]


def test_tagged_texts_equal_tagged_tokens(spark, tmp_path):
    from inkgraph.operators.cutting import tagged_texts

    docs = _docs(spark)
    for name, pattern in tokens.PATTERNS.items():
        plain = tokens.tagged(tokens.tokenize(docs, {name: pattern}))
        _same(tagged_texts(docs, name).select(plain.columns), plain)
    docs.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text")}).write.parquet(f"{tmp_path}/documents.parquet")
    # texts are dealt to all tasks, and no array of tokens is made
    plan = registry.queries()["tokens_with_feature"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "Generate" not in plan
