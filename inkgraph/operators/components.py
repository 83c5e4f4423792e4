"""Weakly connected components by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgraph.plans.scratch import written


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every end of an edge; component is the smallest node that it reaches.

    Every node points to a smaller or equal one. In a round it, and the node it points to, take the
    least of what its neighbours' targets point to, and pointers are doubled, so rounds grow with the
    logarithm of the longest path. Direction, repeated edges and self loops do not matter; edges with a
    null end are left out. Each round is written to the shared folder, so a lost executor costs one
    round at most. Minima are taken with partial sums, so a node with very many edges does no harm.
    An empty table of edges gives an empty result.
    """
    ends = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    both = written(ends.union(ends.select("v", "u")).distinct(), "edges")
    points = written(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("to")), "points")
    measure = [F.count("*"), F.sum(F.xxhash64("node", "to").cast("decimal(38,0)"))]
    state = points.agg(*measure).first()
    both = both.where("u <> v")
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        far = points.join(points.select(F.col("node").alias("to"), F.col("to").alias("far")), "to")
        near = both.join(far.select(F.col("node").alias("v"), "far"), "v").groupBy("u").agg(F.min("far").alias("near"))
        least = far.join(near.withColumnRenamed("u", "node"), "node", "left").select("node", "to", F.least("to", "far", F.coalesce("near", "to")).alias("least"))
        moves = least.select(F.explode(F.array(F.struct("node", F.col("least").alias("to")), F.struct(F.col("to").alias("node"), F.col("least").alias("to")))).alias("m")).select("m.*")
        points = written(moves.groupBy("node").agg(F.min("to").alias("to")), "points")
        after = points.agg(*measure).first()
        if after == state:
            break
        state = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return points.withColumnRenamed("to", "component")
