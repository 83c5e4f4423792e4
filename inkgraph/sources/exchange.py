"""Writers and readers of annotation sets and action graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def annotation_documents(annotations: DataFrame, relations: DataFrame) -> DataFrame:
    """(doc_id, json): a document's annotations in order of start, and its relations; empty fields are left out."""
    a = annotations.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "uid", "annotation_type", "text", "confidence"))).alias("annotations"))
    r = annotations.select("uid", "doc_id").join(relations, F.col("uid") == F.col("source_uid")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("source_uid", "target_uid", "relation_type"))).alias("relations"))
    return a.join(r, "doc_id", "left").select("doc_id", F.to_json(F.struct("annotations", "relations")).alias("json"))


def write_annotations(annotations: DataFrame, relations: DataFrame, path: str) -> None:
    """One JSON line for each document."""
    annotation_documents(annotations, relations).select("doc_id", F.col("json").alias("value")).select(F.concat_ws("\t", F.col("doc_id").cast("string"), "value").alias("value")).write.text(path)


def read_annotations(spark: SparkSession, path: str, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) annotations of written files, with source `file`; rejected ones have an error."""
    kind = "struct<annotations:array<struct<start:bigint,end:bigint,uid:string,annotation_type:string,text:string,confidence:double>>>"
    lines = spark.read.text(path).select(F.substring_index("value", "\t", 1).cast("long").alias("doc_id"), F.from_json(F.expr("substring(value, instr(value, '\t') + 1)"), kind).alias("j"))
    rows = lines.select("doc_id", F.explode("j.annotations").alias("a")).select("doc_id", "a.*", F.lit("file").alias("source"))
    joined = rows.join(texts.select("doc_id", F.length("text").alias("_n")), "doc_id", "left")
    error = F.when(F.col("_n").isNull(), "unknown document").when((F.col("start") < 0) | (F.col("end") <= F.col("start")) | (F.col("end") > F.col("_n")), "offsets outside the text")
    marked = joined.withColumn("error", error).drop("_n")
    return marked.where("error IS NULL").drop("error"), marked.where("error IS NOT NULL")


def write_actions(actions: DataFrame, edges: DataFrame, path: str) -> None:
    """Actions and dependencies as CSV, and both as nodes and edges in JSON."""
    actions.write.option("header", True).csv(f"{path}/actions")
    edges.write.option("header", True).csv(f"{path}/dependencies")
    actions.select(F.col("id"), F.struct(*[c for c in actions.columns if c != "id"]).alias("data")).write.json(f"{path}/nodes")
    edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), *[c for c in edges.columns if c not in ("src", "dst")]).write.json(f"{path}/links")
