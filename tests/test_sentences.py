from pyspark.sql import functions as F

from inkgraph.operators import annotations, chains, syntax, tokens
from inkgraph.operators.sentences import words_in_sentences
from inkgraph.plans import adapters, registry
from inkgraph.plans.scratch import dealt

plan = lambda df: df._jdf.queryExecution().executedPlan().toString()


def test_one_form_has_the_tag_of_the_column_rule(spark):
    forms = ["The", "walked", "going", "12", "²", "Ⅴ", "1a", "tables", "table", "be", "AND", "To", "İs", "ed", "quickly", "né", "x"]
    rows = spark.createDataFrame([(x,) for x in forms], "t string").select("t", tokens.guessed_tag(F.col("t")).alias("tag")).collect()
    assert [(r.t, r.tag) for r in rows] == [(x, tokens.form_tag(x)) for x in forms]


def test_words_are_cut_in_one_pass_over_texts(spark):
    docs = spark.createDataFrame([(1, "He walked to go. 😀 né"), (2, None), (3, "..."), (4, "is a table")], "doc_id long, text string")
    cut = words_in_sentences(docs, ["is"])
    assert "MapInArrow" in plan(cut) and "Generate" not in plan(cut) and "Exchange" not in plan(cut)
    got = sorted((r.doc_id, r.sent_idx, r.token_idx, r.text, r.pos, r.start, r.root, r.after_to, r.next_noun) for r in cut.collect())
    assert got == [
        (1, 0, 0, "He", "NOUN", 0, 1, False, False), (1, 0, 1, "walked", "VERB", 3, 1, False, False), (1, 0, 2, "to", "ADP", 10, 1, False, True), (1, 0, 3, "go", "NOUN", 13, 1, True, False),
        (1, 1, 0, "né", "NOUN", 19, None, False, False), (4, 0, 0, "is", "AUX", 0, None, False, False), (4, 0, 1, "a", "DET", 3, None, False, False), (4, 0, 2, "table", "ADJ", 5, None, False, False)]


def test_dependencies_that_bring_their_words_need_no_join(spark):
    words = spark.createDataFrame([(1, 0, 0, "dogs", "NOUN"), (1, 0, 1, "eat", "VERB"), (1, 0, 2, "meat", "NOUN"), (1, 0, 3, "running", "VERB")], "doc_id long, sent_idx long, token_idx int, text string, pos string")
    bare = spark.createDataFrame([(1, 0, 1, 0, "nsubj"), (1, 0, 1, 1, "root"), (1, 0, 1, 2, "obj"), (1, 0, 1, 3, "advcl")], "doc_id long, sent_idx long, head int, dependent int, relation string")
    own = words.select("doc_id", "sent_idx", F.col("token_idx").alias("dependent"), F.col("text").alias("dependent_text"), F.col("pos").alias("dependent_pos"))
    full = spark.createDataFrame([tuple(r) + ("VERB",) for r in bare.join(own, ["doc_id", "sent_idx", "dependent"]).select(*bare.columns, "dependent_text", "dependent_pos").collect()], "doc_id long, sent_idx long, head int, dependent int, relation string, dependent_text string, dependent_pos string, head_pos string")
    for made in (syntax.direct_verb_links, syntax.subject_verb_object, syntax.noun_phrases, lambda t, d: annotations.display_graph(t, d)[1]):
        assert sorted(map(tuple, made(words, bare).collect())) == sorted(map(tuple, made(words, full).collect())) != []
    assert "Join" not in plan(syntax.direct_verb_links(words, full)) and "Join" not in plan(annotations.display_graph(words, full)[1])


def test_property_graph_compares_no_ids(spark):
    words = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (1, 0, 1), (1, 1, 0), (2, 0, 0)], "doc_id long, sent_idx long, token_idx int")
    nodes, edges = annotations.property_graph(words)
    assert plan(edges).count("Exchange") == 1
    assert sorted(map(tuple, edges.collect())) == [("1", "1.0", "HAS_SENTENCE"), ("1", "1.1", "HAS_SENTENCE"), ("1.0", "1.0.0", "HAS_TOKEN"), ("1.0", "1.0.1", "HAS_TOKEN"), ("1.0.0", "1.0.1", "NEXT"), ("1.1", "1.1.0", "HAS_TOKEN"), ("2", "2.0", "HAS_SENTENCE"), ("2.0", "2.0.0", "HAS_TOKEN")]
    assert nodes.count() == 9


def test_queries_on_the_sentence_table_shuffle_no_words(spark):
    made = registry.queries()
    for name in ("chains_verbs", "chains_sequences", "chains_page", "tokens_feature_table"):
        assert "Exchange" not in plan(made[name](spark, "/root/testdata/sf0.001")), name


def test_relations_within_documents_meet_their_patterns_as_they_lie(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lifted = registry.queries()["patterns_relations"](spark, "/root/testdata/sf0.001")
        assert "Exchange" not in plan(lifted) and "SortMergeJoin" in plan(lifted) and not lifted.isEmpty()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    made = annotations.patterns(spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("c", 2, "x"), ("a", 2, "x")], "uid string, doc_id long, source string").selectExpr("*", "'t' AS text", "'n' AS annotation_type", "0.5D AS confidence"), "x")
    links = spark.createDataFrame([(1, "a", "b"), (1, "a", "a"), (2, "c", "a"), (2, "c", "b"), (1, "b", None), (1, "b", "z")], "doc_id long, source_uid string, target_uid string").withColumn("relation_type", F.lit("NEXT"))
    of = {(r.doc_id, r.source_token_uid): r.pattern_id for r in made.collect()}
    got = annotations.linguistic_relations(links, made, within=("doc_id",))
    assert sorted(map(tuple, got.collect())) == sorted((of[d, a], of[d, b], "NEXT") for d, a, b in [(1, "a", "b"), (1, "a", "a"), (2, "c", "a")])
    unique = made.where("doc_id = 1")  # without columns in common, uids alone decide
    assert annotations.linguistic_relations(links.drop("doc_id").where("source_uid <> 'c'"), unique).count() == 2


def test_buckets_keep_rows_and_spare_shuffles(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("doc_id"), "id", F.when(F.col("id") % 3 > 0, F.col("id")).alias("x"))
    kept = dealt(rows.repartition(5, "doc_id"), "rows", "doc_id", 5)
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    assert "Exchange" not in plan(kept.groupBy("doc_id", "x").agg(F.count("*")))
    assert dealt(rows.where("id < 0"), "rows", "doc_id", 5).isEmpty()


def test_sequences_are_the_same_in_buckets_and_not(spark):
    words = "in order to stop dogs by walking , then barking because eating meat after eating meat . therefore eating meat following running dogs . dogs ended walking to going".split()
    docs = spark.createDataFrame([(k, " ".join(words[k:] + words[:k])) for k in range(len(words))] + [(99, None)], "doc_id long, text string")
    rows = adapters._with_heads(words_in_sentences(docs, ["is"]))
    deps = rows.where("relation IS NOT NULL").select("doc_id", "sent_idx", "head", F.col("token_idx").alias("dependent"), "relation", F.col("text").alias("dependent_text"), F.col("pos").alias("dependent_pos"), "head_pos")
    kept = dealt(rows.repartition(3, "doc_id"), "rows", "doc_id", 3)
    plain, own = (sorted(map(tuple, chains.sequences(t, deps, syntax.direct_verb_links(t, deps), n).collect())) for t, n in ((rows, None), (kept, 3)))
    assert plain == own and {r[5] for r in own} >= {"PURPOSE", "CAUSAL", "RESULT", "TEMPORAL_AFTER"} and any(r[1] < r[3] for r in own)
    # one row for each pair, also where a word comes twice
    twice = sorted(map(tuple, chains.sequences(rows.unionByName(rows), deps, syntax.direct_verb_links(rows, deps)).collect()))
    assert twice == own


def test_nearest_actions_of_many_hits(spark):
    actions = spark.createDataFrame([(1, p, f"a{p}") for p in (5, 20, 21, 900)] + [(2, 3, "b")], "doc_id long, pos int, id string")
    hits = spark.createDataFrame([(1, 0), (1, 20), (1, 22), (1, 300), (1, 1500), (2, 4), (3, 1)], "doc_id long, at int")
    got = chains.nearest_actions(actions, hits)
    assert "unboundedfollowing" not in plan(got) and sorted(map(tuple, got.collect())) == [(1, 0, None, "a5"), (1, 20, "a20", "a21"), (1, 22, "a21", None), (1, 300, "a21", None), (1, 1500, None, None), (2, 4, "b", None), (3, 1, None, None)]
