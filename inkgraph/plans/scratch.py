"""Places in the shared folder of the cluster where lineage is cut."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a new local one if all runs in one process, else ValueError."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-inkgraph-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A path that no other call returns, under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/inkgraph-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: the lineage ends there and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, name: str, key: str, parts: int) -> DataFrame:
    """Like written, but in buckets by a hash of one column: joins, groups and windows by that column, or by it and others, need no shuffle of what is read back.

    A row that comes in the task of its bucket (`repartition(parts, key)`) stays there, so each bucket is one file.
    """
    spark = df.sparkSession
    path, table = scratch(spark, name), f"inkgraph_{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(parts, key).option("path", path).option("compression", "zstd").saveAsTable(table)
    return spark.table(table)
