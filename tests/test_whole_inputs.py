"""Queries without SQL read whole tables: small fixtures against brute force."""

from collections import Counter, defaultdict

from inkgraph.operators import tokens
from inkgraph.plans import registry


def clusters(rows):
    """Of each document: the first free span is a seed and takes all free spans that overlap it by half or more."""
    texts = defaultdict(list)
    for r in rows:
        texts[r.doc_id].append(r)
    for doc in texts.values():
        free = sorted(doc, key=lambda r: (r.start, r.end, r.processor, r.idx))
        while free:
            seed = free[0]
            overlap = [max(0, min(seed.end, r.end) - max(seed.start, r.start)) / (max(seed.end, r.end) - min(seed.start, r.start)) for r in free]
            yield [r for r, o in zip(free, overlap) if o >= 0.5]
            free = [r for r, o in zip(free, overlap) if o < 0.5]


def majority(votes):
    return min(votes, key=lambda pos: (-votes[pos], pos))


def test_votes_over_texts_of_any_length(spark, tmp_path):
    words = "The quickly running analysis, of well-known measurements (x1) becomes interesting. "
    rows = [(1, words, len(words)), (2, words * 60, 60 * len(words)), (3, words + "extra considerations", None), (4, "a-b considerably", 3000), (5, "", 0), (6, None, None)]
    docs = spark.createDataFrame([(a, b, "en", "s", n) for a, b, n in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    all_tokens = tokens.tagged(tokens.tokenize(docs)).collect()
    merged = Counter((",".join(sorted({r.processor for r in c})), majority(Counter(r.pos for r in c))) for c in clusters(all_tokens))
    got = registry.queries()["vote_merge_tokens"](spark, str(tmp_path)).collect()
    assert {(r.sources, r.pos): r.n for r in got} == merged
    entities = Counter()
    for c in clusters([r for r in all_tokens if len(r.text) > 8]):
        votes = Counter(pos for _, pos in {(r.processor, r.pos) for r in c})
        best = majority(votes)
        if votes[best] >= 2:
            entities[best, votes[best]] += 1
    got = registry.queries()["vote_entities"](spark, str(tmp_path)).collect()
    assert {(r.entity_type, r.votes): r.n for r in got} == entities


def test_orders_vote_on_their_dependencies_alone(spark, tmp_path):
    rows = [(1, 7, 1, 1), (21, 7, 1, 2), (41, 7, 1, 1), (41, 7, 1, 2), (3, 8, 2, 4), (23, 8, 2, 1)]
    lines = spark.createDataFrame([(*r, "N", "O", 0.1) for r in rows], "l_orderkey long, l_partkey long, l_linenumber int, l_suppkey long, l_returnflag string, l_linestatus string, l_discount double")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = registry.queries()["vote_dependencies"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.head, r.dependent, r.relation, r.votes) for r in got) == [(3, 8, 2, "obj:O", 1), (41, 7, 1, "obj:O", 2)]


def test_paths_that_the_cutoff_ends_equal_their_sql(spark, tmp_path):
    """Ids that lie more than ten halvings over a start: the query ends their paths at its cutoff, and so does its SQL."""
    from oracle import same
    from inkgraph.plans import registry

    docs = [(50 * 2**k, "x") for k in range(13)]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    name = "graph_simple_paths"
    assert same(spark, registry.queries()[name], registry.oracle_sql()[name], str(tmp_path)) > 0
    cut = registry.queries()[name](spark, str(tmp_path)).where("NOT complete").collect()
    assert cut and all(r.path.count(">") == 10 for r in cut)


def test_edit_range_finds_each_length_once(spark):
    """The halving of the suffix must not hold that of the prefix: the plan names the texts a bounded number of times."""
    from pyspark.sql import functions as F
    from inkgraph.operators.annotations import edit_range

    rows = spark.createDataFrame([("abcdef", "abXYef"), ("same", "same"), ("", "new"), ("aaa", "aa")], "o string, n string")
    found = rows.select("o", "n", edit_range(F.col("o"), F.col("n")).alias("r"))
    assert found._jdf.queryExecution().analyzed().toString().count("aggregate(") == 2
    assert [tuple(r.r) for r in found.collect()] == [(2, 4, 4), (4, 4, 4), (0, 0, 3), (2, 3, 2)]


def test_tokens_longer_than_a_stretch_are_found(spark):
    from inkgraph.operators import tokens

    docs = spark.createDataFrame([(1, "a \U0001F600" + "b" * 300 + "\n c\nd"), (2, None)], "doc_id long, text string")
    found = tokens.tokenize(docs, {"space": r"\S+"})
    assert [tuple(r) for r in tokens.offsets_hold(found, docs).collect()] == [(4, 4)]
    assert [tuple(r) for r in tokens.offsets_hold(found.withColumn("start", found.start + 1), docs).collect()] == [(4, 0)]
