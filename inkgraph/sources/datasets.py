"""Samples of annotated documents written to a folder with a manifest, and loaded back with checks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgraph.operators import annotations as an
from inkgraph.operators import text

#: Tables of a sample beside its metadata and text; each needs a doc_id.
PARTS = ("annotations", "relations", "patterns", "chains")
#: What a document must have to be exported.
MANDATORY = ("text", "patterns", "chains")


def sample_ids(doc_id: Column, stamp: str, seed: int = 0) -> Column:
    """`<doc_id>_<stamp>_<six hex digits>`; the digits follow from the document and the seed."""
    return F.concat_ws("_", doc_id.cast("string"), F.lit(stamp), F.substring(F.md5(F.concat_ws(":", doc_id.cast("string"), F.lit(str(seed)))), 1, 6))


def export_dataset(path: str, documents: DataFrame, parts: dict[str, DataFrame], stamp: str, seed: int = 0) -> DataFrame:
    """Write samples of documents to `path`; returns the manifest as it is stored.

    documents: doc_id, user_text, formatted_text, raw_text (the first that is not null is the sample's
    text) and any metadata columns. parts: a table for each of PARTS, with a doc_id; tables without rows
    of a document count 0. Documents that lack a text, patterns or chains are not written, and `missing`
    in the manifest names what they lack. Rows with a null doc_id belong to no sample. doc_id is unique
    in documents. Parts are read twice, to be counted and to be written, so give stored ones.

    Each table is one Parquet folder with a sample_id, not a folder for each sample: files stay large
    whatever the number of samples. The manifest is written last, so a folder without one is no dataset.
    """
    if set(parts) != set(PARTS):
        raise ValueError(f"parts must be {PARTS}")
    known = documents.where("doc_id IS NOT NULL")
    versions = text.active_version(known)
    manifest = versions.select("doc_id", sample_ids(F.col("doc_id"), stamp, seed).alias("sample_id"), F.when(F.col("text").isNotNull(), 1).otherwise(0).cast("long").alias("text"))
    for name in PARTS:
        manifest = manifest.join(parts[name].groupBy("doc_id").agg(F.count("*").alias(name)), "doc_id", "left")
    manifest = manifest.na.fill(0, list(PARTS)).withColumn("missing", F.concat_ws(",", *(F.when(F.col(k) == 0, F.lit(k)) for k in MANDATORY)))
    manifest.write.parquet(f"{path}/samples")
    stored = known.sparkSession.read.parquet(f"{path}/samples")
    whole = stored.where("missing = ''").select("doc_id", "sample_id")
    meta = [c for c in documents.columns if c not in ("user_text", "formatted_text", "raw_text")]
    known.select(*meta).join(whole, "doc_id").write.parquet(f"{path}/metadata")
    versions.join(whole, "doc_id").write.parquet(f"{path}/texts")
    for name in PARTS:
        parts[name].join(whole, "doc_id").write.parquet(f"{path}/{name}")
    stored.write.parquet(f"{path}/manifest")
    return known.sparkSession.read.parquet(f"{path}/manifest")


def differences(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, part, wanted, found): where the files of a dataset hold another number of rows than its manifest says."""
    manifest = _manifest(spark, path).where("missing = ''")
    names = {"texts": "text"} | {k: k for k in PARTS}
    pairs = F.array(*(F.struct(F.lit(k).alias("part"), F.col(c).alias("wanted")) for k, c in names.items()), F.struct(F.lit("metadata").alias("part"), F.lit(1).cast("long").alias("wanted")))
    wanted = manifest.select("sample_id", F.explode(pairs).alias("p")).select("sample_id", "p.*")
    found = None
    for name in ("metadata", *names):
        rows = spark.read.parquet(f"{path}/{name}").groupBy("sample_id").agg(F.count("*").alias("found")).withColumn("part", F.lit(name))
        found = rows if found is None else found.unionByName(rows)
    both = wanted.join(found, ["sample_id", "part"], "full").na.fill(0, ["wanted", "found"])
    return both.where("wanted <> found").select("sample_id", "part", "wanted", "found")


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(f"{path}/manifest")
    except AnalysisException as error:
        raise ValueError(f"{path} has no manifest: its export did not end") from error


def import_dataset(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a dataset: metadata, texts, annotations, relations, patterns, properties, chains, and what was left out.

    `refused` has the differences from the manifest; all rows of such a sample stay out. Annotations
    without a confidence or source get 1.0 and `dataset_import`. `skipped` has relations with an end that is
    no annotation of their sample. `properties` are the merged (pattern_id, type, value) of the patterns.
    """
    refused = differences(spark, path)
    gone = refused.select("sample_id").distinct()
    out = {name: spark.read.parquet(f"{path}/{name}").join(gone, "sample_id", "left_anti") for name in ("metadata", "texts", *PARTS)}
    out["annotations"] = out["annotations"].withColumn("confidence", F.coalesce("confidence", F.lit(1.0))).withColumn("source", F.coalesce("source", F.lit("dataset_import")))
    ends = out["annotations"].select("sample_id", "uid").distinct()
    joined = out["relations"].join(ends.select("sample_id", F.col("uid").alias("source_uid"), F.lit(True).alias("_s")), ["sample_id", "source_uid"], "left").join(ends.select("sample_id", F.col("uid").alias("target_uid"), F.lit(True).alias("_t")), ["sample_id", "target_uid"], "left")
    both = F.col("_s").isNotNull() & F.col("_t").isNotNull()
    out["relations"], out["skipped"] = joined.where(both).drop("_s", "_t"), joined.where(~both).drop("_s", "_t")
    out["properties"] = an.pattern_properties(out["patterns"]).distinct()
    return out | {"refused": refused}


def merged_tables(existing: dict[str, DataFrame], imported: dict[str, DataFrame], clean: bool) -> dict[str, DataFrame]:
    """existing tables (each with a doc_id) with the imported rows: clean takes out all that is known of imported documents first; else equal rows are kept once."""
    documents = imported["metadata"].select("doc_id").distinct()
    out = {}
    for name, rows in existing.items():
        new = imported[name].select(*rows.columns)
        out[name] = rows.join(documents, "doc_id", "left_anti").unionByName(new) if clean else rows.unionByName(new).distinct()
    return out
