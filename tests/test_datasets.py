"""Samples and their manifest, Markdown pieces, automatic annotations, proportional cuts and coordinated nouns: hand tables and plain Python."""

import itertools
import os
import random
import re
import shutil

import pytest
from pyspark.sql import functions as F

from inkgraph.operators import annotations as an
from inkgraph.operators import syntax, text
from inkgraph.sources import datasets


def samples(spark):
    docs = spark.createDataFrame([(1, "t1", None, "form", "raw"), (2, "t2", "user", "form", "raw"), (3, "t3", None, None, "raw"), (4, "t4", None, None, None), (None, "t5", "x", None, None)], "doc_id long, title string, user_text string, formatted_text string, raw_text string")
    a = spark.createDataFrame([("a", 1, "NOUN", 0, 2, "fo", None, None), ("b", 1, "VERB", 2, 4, "rm", "user", 0.5), ("c", 2, "NOUN", 0, 4, "user", "user", 0.9), ("d", None, "NOUN", 0, 1, "x", "user", 0.9)], "uid string, doc_id long, annotation_type string, start long, end long, text string, source string, confidence double")
    r = spark.createDataFrame([(1, "a", "b", "NEXT"), (1, "a", "c", "NEXT"), (1, "b", None, "NEXT"), (2, "c", "c", "SELF")], "doc_id long, source_uid string, target_uid string, relation_type string")
    p = spark.createDataFrame([(1, "p1", "a", "fo", "NOUN", 0.5), (1, "p1", "a", "fo", "NOUN", None), (2, "p2", "c", "", None, 0.9), (4, "p4", "z", "z", "NOUN", 0.1)], "doc_id long, pattern_id string, source_token_uid string, text string, annotation_type string, confidence double")
    c = spark.createDataFrame([(1, "x", "y"), (2, "x", "z"), (4, "x", "z")], "doc_id long, verb1 string, verb2 string")
    return docs, {"annotations": a, "relations": r, "patterns": p, "chains": c}


def test_samples_come_back(spark, tmp_path):
    docs, parts = samples(spark)
    manifest = datasets.export_dataset(f"{tmp_path}/d", docs, parts, "2024", seed=7)
    got = {r.doc_id: (r.text, r.annotations, r.relations, r.patterns, r.chains, r.missing) for r in manifest.collect()}
    assert got == {1: (1, 2, 3, 2, 1, ""), 2: (1, 1, 1, 1, 1, ""), 3: (1, 0, 0, 0, 0, "patterns,chains"), 4: (0, 0, 0, 1, 1, "text")}
    assert all(re.fullmatch(rf"{r.doc_id}_2024_[0-9a-f]{{6}}", r.sample_id) for r in manifest.collect())
    out = datasets.import_dataset(spark, f"{tmp_path}/d")
    assert out["refused"].isEmpty()
    assert {(r.doc_id, r.version, r.text) for r in out["texts"].collect()} == {(1, "formatted", "form"), (2, "user", "user")}
    assert {(r.doc_id, r.title) for r in out["metadata"].collect()} == {(1, "t1"), (2, "t2")}
    assert {(r.uid, r.source, r.confidence) for r in out["annotations"].collect()} == {("a", "dataset_import", 1.0), ("b", "user", 0.5), ("c", "user", 0.9)}
    assert sorted((r.source_uid, r.target_uid) for r in out["relations"].collect()) == [("a", "b"), ("c", "c")]
    assert out["skipped"].count() == 2  # an end in another sample, an end that is null
    assert sorted((r.pattern_id, r.type, r.value) for r in out["properties"].collect()) == [("p1", "annotation_type", "NOUN"), ("p1", "confidence", "0.5"), ("p1", "text", "fo"), ("p2", "confidence", "0.9")]


def test_half_written_samples_are_refused(spark, tmp_path):
    docs, parts = samples(spark)
    datasets.export_dataset(f"{tmp_path}/d", docs, parts, "2024")
    shutil.move(f"{tmp_path}/d/manifest", f"{tmp_path}/manifest")
    with pytest.raises(ValueError, match="no manifest"):
        datasets.import_dataset(spark, f"{tmp_path}/d")
    shutil.move(f"{tmp_path}/manifest", f"{tmp_path}/d/manifest")
    left = spark.read.parquet(f"{tmp_path}/d/annotations").where("uid <> 'b'").toPandas()
    shutil.rmtree(f"{tmp_path}/d/annotations")
    os.mkdir(f"{tmp_path}/d/annotations")
    left.to_parquet(f"{tmp_path}/d/annotations/part.parquet")
    out = datasets.import_dataset(spark, f"{tmp_path}/d")
    assert [(r.part, r.wanted, r.found) for r in out["refused"].collect()] == [("annotations", 2, 1)]
    assert all({r.doc_id for r in out[k].collect()} == {2} for k in ("metadata", "texts", "annotations", "relations", "patterns", "chains"))


def test_imported_rows_replace_or_join(spark, tmp_path):
    docs, parts = samples(spark)
    datasets.export_dataset(f"{tmp_path}/d", docs, parts, "2024")
    out = datasets.import_dataset(spark, f"{tmp_path}/d")
    known = spark.createDataFrame([(1, "old", "w"), (1, "x", "y"), (9, "x", "y")], "doc_id long, verb1 string, verb2 string")
    rows = lambda clean: sorted(tuple(r) for r in datasets.merged_tables({"chains": known}, out, clean)["chains"].collect())
    assert rows(True) == [(1, "x", "y"), (2, "x", "z"), (9, "x", "y")]
    assert rows(False) == [(1, "old", "w"), (1, "x", "y"), (2, "x", "z"), (9, "x", "y")]


def test_empty_tables_make_an_empty_dataset(spark, tmp_path):
    docs, parts = samples(spark)
    assert datasets.export_dataset(f"{tmp_path}/d", docs.limit(0), {k: v.limit(0) for k, v in parts.items()}, "2024").count() == 0
    assert all(v.isEmpty() for v in datasets.import_dataset(spark, f"{tmp_path}/d").values())


DRAFT = "---\nk: v\n---\n#  A title \n| lone |\ntext\n| a |\n| b |\n|:--|\n| c |\n---\nhidden\n---\n| d |\nend\n### Done.\n### References\n## References\n[1] x"


def test_markdown_pieces_make_the_filtered_text(spark):
    df = spark.createDataFrame([(1, DRAFT), (2, "a\n---\nopen"), (3, ""), (4, None), (5, "# T"), (6, "one\r\n# Two")], "doc_id long, text string")
    pieces = text.markdown_pieces(df)
    got = {r.doc_id: r.text for r in text.joined_pieces(df, pieces).collect()}
    assert got == {1: "A title.\n| lone |\ntext\n| a |\nend\nDone.\nReferences.\n", 2: "a\n", 3: "", 4: "", 5: "T.", 6: "one\r\nTwo."}
    texts = {1: DRAFT, 2: "a\n---\nopen", 5: "# T", 6: "one\r\n# Two"}
    for r in pieces.collect():
        there = texts[r.doc_id][r.original_start : r.original_start + r.length]
        assert got[r.doc_id][r.filtered_start : r.filtered_start + r.length] == r.text
        assert there == r.text or r.text == "."  # a period that is put in has no place of its own


def test_automatic_annotations_stand_in_the_text(spark):
    df = spark.createDataFrame([(1, DRAFT), (2, "---\nx"), (3, None), (4, "end and end")], "doc_id long, text string")

    def annotate(filtered):
        word = F.explode(F.array(*(F.struct(F.lit(w).alias("w"), F.lit(c).alias("c"), F.lit(t).alias("t")) for w, c, t in (("title", 0.9, "A"), ("title", 0.8, "B"), ("text", 0.7, "A"), ("end", 0.6, "A"), ("Done", 0.9, "C"), ("lone", None, "A")))))
        spans = filtered.select("doc_id", "text", word.alias("x")).select("doc_id", F.instr("text", F.col("x.w")).cast("long").alias("at"), "x.*").where("at > 0")
        spans = spans.select("doc_id", (F.col("at") - 1).alias("start"), (F.col("at") - 1 + F.length("w")).alias("end"), F.col("w").alias("text"), F.col("t").alias("annotation_type"), F.col("c").alias("confidence"))
        a = spans.select("doc_id", F.col("start").alias("source_start"), F.col("end").alias("source_end"))
        b = spans.select("doc_id", F.col("start").alias("target_start"), F.col("end").alias("target_end"))
        return spans, a.join(b, "doc_id").where("source_start < target_start").withColumn("relation_type", F.lit("BEFORE"))

    found, links = an.auto_annotated(df, annotate)
    rows = found.collect()
    assert sorted((r.text, r.annotation_type) for r in rows) == [("Done", "C"), ("text", "A"), ("title", "A"), ("title", "B")]
    assert all(DRAFT[r.start : r.end] == r.text for r in rows)
    at = {(r.text, r.annotation_type): r.uid for r in rows}
    assert {(r.source_uid, r.target_uid) for r in links.collect()} == {(at["title", "B"], at["text", "A"]), (at["title", "B"], at["Done", "C"]), (at["text", "A"], at["Done", "C"])}
    assert {r.annotation_type for r in an.auto_annotated(df, annotate, ["A"])[0].collect()} == {"A"}


def cuts(whole, sizes, window):
    total, begin, out = sum(sizes), 0, []
    for k, n in enumerate(sizes):
        end = min(begin + (len(whole) * n // total if total else len(whole) // len(sizes)), len(whole))
        low = max(0, end - window)
        near = whole[low : end + window].rfind("\n\n")
        if near >= 0 and low + near + 2 > begin:
            end = low + near + 2
        out.append((begin, len(whole) if k == len(sizes) - 1 else end))
        begin = end
    return out


def test_texts_are_split_like_others(spark):
    rng = random.Random(5)
    texts = {k: "".join(rng.choice(["é", "a", "\n\n", "bcdef ", "\n"]) for _ in range(rng.randrange(1, 400))) for k in range(30)} | {30: "", 31: None, 32: "no parts"}
    parts = [(k, i, rng.choice([0, 5, 100, 300])) for k in texts if k != 32 for i in range(rng.randrange(1, 6))]
    df, p = spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(parts, "doc_id long, chunk_no int, n_chars int")
    rows = text.split_like(df, p, 20).collect()
    for k, whole in texts.items():
        sizes = [n for d, _, n in sorted(parts) if d == k]
        mine = sorted((r.chunk_no, r.start, r.end, r.text) for r in rows if r.doc_id == k)
        assert [(a, b) for _, a, b, _ in mine] == (cuts(whole or "", sizes, 20) if sizes else [])
        if sizes:
            assert "".join(t for *_, t in mine) == (whole or "")


def test_coordinated_nouns_give_every_combination(spark):
    def sentence(words, links, ands):
        return words.split(), links, ands

    cases = {
        0: sentence("cats and dogs chase mice and rats", [(0, 2), (4, 6)], [(2, 1), (6, 5)]),
        1: sentence("cats , dogs and birds sing", [(0, 2), (2, 4)], [(4, 3)]),
        2: sentence("cats or dogs sing", [(0, 2)], [(2, 1)]),  # no and
        3: sentence("run and cats sing", [(0, 2)], [(2, 1)]),  # a group of one noun
        4: sentence("cats and run and dogs sing", [(0, 2), (2, 4)], [(2, 1), (4, 3)]),  # through a verb; only its own `and` goes
    }
    words, deps = [], []
    for k, (tokens, links, ands) in cases.items():
        words += [(1, k, i, w, "VERB" if w in ("run", "chase", "sing") else "NOUN" if len(w) > 3 else "X") for i, w in enumerate(tokens)]
        deps += [(1, k, h, d, "conj") for h, d in links] + [(1, k, h, d, "cc") for h, d in ands]
    t, d = spark.createDataFrame(words, "doc_id long, sent_idx int, token_idx int, text string, pos string"), spark.createDataFrame(deps, "doc_id long, sent_idx int, head int, dependent int, relation string")
    groups = syntax.noun_groups(t, d)
    got = {}
    for r in sorted(syntax.split_coordinated(t, groups).collect(), key=lambda r: (r.sent_idx, r.variant)):
        got.setdefault(r.sent_idx, []).append(r.text)
    assert got == {
        0: [f"{a} chase {b}" for a, b in itertools.product(("cats", "dogs"), ("mice", "rats"))],
        1: ["cats , sing", ", dogs sing", ", birds sing"],
        4: ["cats and run sing", "and run dogs sing"],
    }
    chosen = groups.withColumn("digits", F.transform("groups", lambda g: F.size(g) - 1))
    assert {(r.sent_idx, r.text) for r in syntax.coordinated_variants(t, chosen).collect()} == {(k, v[-1]) for k, v in got.items()}
