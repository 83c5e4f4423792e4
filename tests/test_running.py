from pyspark.sql import functions as F

from inkgraph.operators import tokens
from inkgraph.operators.running import running_sums, runs
from inkgraph.plans.adapters import _with_heads, _words


def test_sums_and_runs_of_each_array(spark):
    rows = spark.createDataFrame([(1, [3, 0, 2], [False, True, False], [False, False, True]), (2, [], [], []), (3, None, None, None), (4, [5, 1], [True, True], [True, False])], "k int, n array<int>, new array<boolean>, mark array<boolean>").coalesce(1)
    got = {r.k: r for r in rows.select("k", running_sums("n").alias("s"), runs("new", "mark").alias("r")).collect()}
    assert [got[k].s for k in (1, 2, 3, 4)] == [[3, 3, 5], [], None, [5, 6]]
    assert [tuple(x) for x in got[1].r] == [(0, 0, None), (1, 0, 1), (1, 1, 1)]
    assert got[2].r == [] and got[3].r is None
    assert [tuple(x) for x in got[4].r] == [(1, 0, 0), (2, 0, None)]


def test_no_word_is_shuffled_or_sorted(spark):
    docs = spark.createDataFrame([(1, "a bc"), (2, None), (3, "")], "doc_id long, text string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan(tokens.tokenize(docs)) for x in ("Exchange", "Sort", "Window"))
    words = plan(_with_heads(_words(spark, "/root/testdata/sf0.001")))
    assert words.count("Exchange") == 1 and "Window" not in words and "Sort" not in words  # whole texts are dealt once
    assert sorted((r.processor, r.idx, r.text, r.start, r.end) for r in tokens.tokenize(docs).where("processor <> 'mark'").collect()) == [("space", 0, "a", 0, 1), ("space", 1, "bc", 2, 4), ("word", 0, "a", 0, 1), ("word", 1, "bc", 2, 4)]


def test_offsets_count_code_points(spark):
    docs = spark.createDataFrame([(7, "\U0001F600 né x")], "doc_id long, text string")
    got = tokens.tokenize(docs, {"space": r"\S+"}).where(F.substring(F.lit("\U0001F600 né x"), F.col("start").cast("int") + 1, F.length("text")) == F.col("text"))
    assert got.count() == 3


def test_votes_deal_the_tokens_once(spark):
    from inkgraph.operators import voting

    docs = spark.createDataFrame([(1, "a b-c"), (2, None)], "doc_id long, text string")
    voted = voting.vote_tokens(voting.cluster_tokens(tokens.tagged(tokens.tokenize(docs))))
    assert voted._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_each_marker_is_looked_for_once(spark):
    from inkgraph.operators import actions

    docs = spark.createDataFrame([(1, "we aim to see, then to do; to be"), (2, "none"), (3, None)], "doc_id long, text string")
    found = actions.marker_hits(docs)
    spark.conf.set("spark.sql.debug.maxToStringFields", 10_000)
    try:
        assert found._jdf.queryExecution().analyzed().toString().count("regexp_extract_all(") == sum(len(m[3]) for m in actions.MARKERS)
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert sorted((r.doc_id, r.at, r.marker) for r in found.where("marker IN ('to', 'then')").collect()) == [(1, 7, "to"), (1, 15, "then"), (1, 20, "to")]
