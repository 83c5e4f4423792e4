import corpus_pipeline
from inkgraph.llm import decontaminate, jaccard, mixing, quality, toxicity

FOLDER = "/root/testdata/sf0.001"


def test_stages_apply_their_operators_to_all_that_is_left(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    left = docs.collect()
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).collect(), docs.schema)
        before = spark.createDataFrame(left, docs.schema)
        assert docs.columns == columns
        if name == "quality classifier":
            scores = quality.score_quality(before, quality.train(before, labels))
            want = {r.doc_id for r in scores.collect() if r.score >= 0.3}
        elif name == "toxicity":
            scores = toxicity.score_toxicity(before, toxicity.train(before, labels))
            want = {r.doc_id for r in scores.collect() if r.score < 0.5}
        elif name == "n-gram Jaccard join":
            want = {r.doc_id for r in jaccard.link_classes(before, 5, 80).collect() if r.doc_id == r.component_id}
        else:
            want = {r.doc_id for r in left} - {r.doc_id for r in decontaminate.find_leaks(before, benchmark).collect()}
        got = docs.collect()
        assert {r.doc_id for r in got} == want and len(got) == len(want)
        left = got
    final = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert {r.doc_id for r in final} == {r.doc_id for r in mixing.sample_mix(docs).collect()}
    assert 0 < len(final) < len(left) < 200
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "toxicity", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights"]
