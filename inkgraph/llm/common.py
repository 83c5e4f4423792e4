"""What the operators of this folder share: session settings, folds and bounded training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch. Texts are a few kB on average and can be 100 kB and more.
ARROW_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold few rows, so that whole texts fit in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def fold(column: str, folds: int) -> Column:
    """crc32 of the column as text, modulo folds; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, folds: int, most: tuple[int, int]) -> DataFrame:
    """(doc_id, text, label) of at most so many documents labelled 0 and so many labelled 1, outside fold 0: whole texts.

    They are those with the smallest hash of doc_id, so the sample does not depend on partitions.
    Only their ids, a bounded number, are broadcast to find the texts. A doc_id with both labels has
    label 1; of texts with the same doc_id one counts, that with the smallest hash.
    """
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != 0))
    usable = usable.groupBy("doc_id").agg(F.max(label).alias("label")).withColumn("_draw", F.xxhash64("doc_id"))
    # ids that the documents have, so that a filtered input still fills the sample
    usable = usable.join(documents.select("doc_id").distinct(), "doc_id", "left_semi")
    picked = None
    for value in (0, 1):
        part = usable.where(F.col("label") == value).orderBy("_draw", "doc_id").limit(most[value])
        picked = part if picked is None else picked.unionByName(part)
    rows = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(picked.select("doc_id", "label")), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
