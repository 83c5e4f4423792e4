"""Ranks inside groups that may be as large as the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from inkgraph.plans.scratch import written


def ranked(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """rows with their place, from 0, in their group by the order columns.

    The rows are dealt by ranges of (group, order), so a large group is sorted in many tasks; a row's
    place is its place in its range and the number of the group's rows in the ranges before. Ranges are
    written once, since the places and the numbers must come from the same ones. Rows equal in all
    these columns come in any order; a null group is a group of its own. No rows: no rows.
    """
    ranges = written(rows.repartitionByRange(group, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    earlier = W.partitionBy(group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sizes = ranges.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    starts = sizes.select(F.col(group).alias("_group"), F.col("_range").alias("_start_range"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    own = F.row_number().over(W.partitionBy(group, "_range").orderBy(*order)) - 1
    placed = ranges.withColumn("_own", own).join(starts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_start_range")))
    return placed.select(*rows.columns, (F.col("_before") + F.col("_own")).alias(name))
