"""The best paths of an acyclic graph without listing all of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from inkgraph.operators import graph
from inkgraph.plans.scratch import scratch, written

#: Confidences are added as whole numbers of this part, so that sums don't depend on their order.
UNIT = 1_000_000


def best_paths(edges: DataFrame, most: int = 50, least_edges: int = 2, maximal: bool = True) -> DataFrame:
    """(path, length, confidence, rank): the `most` best paths from vertices without predecessors, by length and then mean confidence of the edges, both descending, ties by path.

    edges: src, dst, confidence (null counts 0); of repeated edges the most confident counts, loops and null ends are
    left out. maximal asks for paths that end where no edge leads on; otherwise each beginning of a path counts as well.

    Of all paths to a vertex only the best `most` are kept: whatever follows, a better path to a vertex stays better
    than another path to it, since the rest adds the same to both. So the rows are at most `most` for each vertex,
    however many paths there are. Vertices are taken layer by layer; an edge is used once, when the layer of its
    source is done, and what it brings waits in a folder of the layer of its target. Raises ValueError on a cycle.
    """
    spark = edges.sparkSession
    known = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
    clean = written(known.groupBy("src", "dst").agg(F.max(F.round(F.coalesce("confidence", F.lit(0.0)) * UNIT).cast("long")).alias("c")), "edges")
    layers = graph.assign_layers(clean)
    if not layers.where("layer IS NULL").isEmpty():
        raise ValueError("the graph has a cycle")
    at = lambda end: layers.select(F.col("v").alias(end), F.col("layer").alias(f"{end}_layer"))
    steps = scratch(spark, "steps")
    stepped = clean.join(at("src"), "src").join(at("dst"), "dst").select("src", "dst", "c", "dst_layer", "src_layer")
    stepped.write.partitionBy("src_layer").parquet(steps)
    by_layer = spark.read.schema(stepped.schema).parquet(steps)
    depth = layers.agg(F.max("layer")).first()[0]
    order = [F.desc("length"), F.desc("sum"), F.asc("path")]
    ended = clean.select(F.col("src").alias("v")).distinct()
    first = layers.where("layer = 0").select("v", F.lit(0).alias("length"), F.lit(0).cast("long").alias("sum"), F.array("v").alias("path"))
    waiting: list[DataFrame] = []
    found = []
    for k in range((depth or 0) + 1):
        if k == 0:
            here = first
        else:
            # a folder of an earlier layer holds what its edges bring, by the layer they lead to
            parts = [w.where(F.col("dst_layer") == k).select("v", "length", "sum", "path") for w in waiting]
            rows = reduce(DataFrame.unionByName, parts)
            here = written(rows.withColumn("_r", F.row_number().over(W.partitionBy("v").orderBy(*order))).where(F.col("_r") <= most).drop("_r"), "best")
            found.append(here)
        if k == depth or depth is None:
            break
        onward = by_layer.where(F.col("src_layer") == k).select(F.col("src").alias("v"), "dst", "dst_layer", "c")
        grown = here.join(onward, "v").select(F.col("dst").alias("v"), "dst_layer", (F.col("length") + 1).alias("length"), (F.col("sum") + F.col("c")).alias("sum"), F.concat("path", F.array("dst")).alias("path"))
        grown = grown.withColumn("_r", F.row_number().over(W.partitionBy("v").orderBy(*order))).where(F.col("_r") <= most).drop("_r")
        grown = grown.select("v", "length", "sum", "path", "dst_layer")
        folder = scratch(spark, f"waiting{k}")
        grown.write.partitionBy("dst_layer").parquet(folder)
        waiting.append(spark.read.schema(grown.schema).parquet(folder))
    rows = reduce(DataFrame.unionByName, found) if found else first
    rows = rows.where(F.col("length") >= least_edges)
    if maximal:
        rows = rows.join(ended, "v", "left_anti")
    top = rows.orderBy(*order).limit(most)  # a bounded number of rows, so one task ranks them
    return top.select("path", "length", F.round(F.col("sum") / F.greatest(F.col("length"), F.lit(1)) / UNIT, 6).alias("confidence"), F.row_number().over(W.orderBy(*order)).alias("rank"))
