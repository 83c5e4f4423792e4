"""Edge tables: cleaning, degrees, order, layers, paths and statistics. Edges are (src, dst) from cited to citing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from inkgraph.operators.components import connected_components
from inkgraph.operators.ranks import ranked
from inkgraph.plans.scratch import dealt, written


def clean_edges(edges: DataFrame) -> DataFrame:
    """Without blank ids, self loops and repeats."""
    return edges.select("src", "dst").where((F.trim("src") != "") & (F.trim("dst") != "") & (F.col("src") != F.col("dst"))).distinct()


def edge_quality(edges: DataFrame) -> DataFrame:
    """One row: blank sources and targets, self loops, valid, unique and duplicate edges."""
    blank_src, blank_dst = F.coalesce(F.trim("src") == "", F.lit(True)), F.coalesce(F.trim("dst") == "", F.lit(True))
    loop = ~blank_src & ~blank_dst & (F.col("src") == F.col("dst"))
    valid = ~blank_src & ~blank_dst & ~loop
    counts = edges.groupBy("src", "dst").agg(F.count("*").alias("n"))
    valid_n = F.sum(F.when(valid, F.col("n")).otherwise(0))
    unique_n = F.sum(F.when(valid, 1).otherwise(0))
    return counts.agg(
        F.sum("n").alias("edges"),
        F.sum(F.when(blank_src, F.col("n")).otherwise(0)).alias("blank_src"),
        F.sum(F.when(blank_dst, F.col("n")).otherwise(0)).alias("blank_dst"),
        F.sum(F.when(loop, F.col("n")).otherwise(0)).alias("self_loops"),
        valid_n.alias("valid"),
        unique_n.alias("unique_edges"),
        (valid_n - unique_n).alias("duplicates"),
    )


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("v")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(v, out_degree, in_degree) of all ends, in one shuffle."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("v"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("v"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    return ends.groupBy("v").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def component_sizes(edges: DataFrame) -> DataFrame:
    """(component, size), the component named by its smallest vertex."""
    return connected_components(edges).groupBy("component").agg(F.count("*").alias("size"))


def edge_parts(spark: SparkSession) -> int:
    """Buckets of tables by vertex: as many as a shuffle has partitions, so that what is shuffled by vertex meets them as they lie."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt_edges(edges: DataFrame) -> DataFrame:
    """Distinct edges (src, dst) in buckets by src, with one shuffle: joins and groups by src need no other."""
    parts = edge_parts(edges.sparkSession)
    return dealt(edges.select("src", "dst").repartition(parts, "src").distinct(), "edges", "src", parts)


def assign_layers(edges: DataFrame, max_rounds: int = 10_000, dealt_by_src: bool = False) -> DataFrame:
    """(v, layer): sources 0, others one more than their highest predecessor; null where a cycle lies on the vertex or before it.

    A round peels the vertices whose predecessors are all peeled. Only the edges that leave the last
    layer are shuffled in a round, as counts by their target, so an edge moves once over all rounds. Rounds are as many as the
    longest path has vertices. dealt_by_src tells that the edges come from `dealt_edges`. The layers lie in buckets by v.
    """
    parts = edge_parts(edges.sparkSession)
    edges = edges.select("src", "dst") if dealt_by_src else dealt_edges(edges)
    state = degrees(edges).select("v", F.col("in_degree").alias("left"), F.when(F.col("in_degree") == 0, 0).alias("layer"))
    state = dealt(state, "layers", "v", parts)
    for k in range(max_rounds):
        last = state.where(F.col("layer") == k).select(F.col("v").alias("src"))
        if last.isEmpty():
            return state.select("v", "layer")
        gone = edges.join(last.hint("merge"), "src").groupBy(F.col("dst").alias("v")).agg(F.count("*").alias("gone"))
        left = F.col("left") - F.coalesce("gone", F.lit(0))
        state = state.join(gone.hint("merge"), "v", "left").select("v", left.alias("left"), F.when(F.col("layer").isNull() & (left == 0), k + 1).otherwise(F.col("layer")).alias("layer"))
        state = dealt(state, "layers", "v", parts)
    raise RuntimeError(f"more than {max_rounds} layers")


def is_dag(layers: DataFrame) -> DataFrame:
    """One row: is_dag, vertices on a cycle or behind one."""
    return layers.agg((F.count(F.when(F.col("layer").isNull(), 1)) == 0).alias("is_dag"), F.count(F.when(F.col("layer").isNull(), 1)).alias("cyclic_upstream"))


def topological_order(layers: DataFrame, strict: bool = False) -> DataFrame:
    """(v, layer, position): positions over (layer, v): the place in the layer, which many tasks sort, behind the sizes of the layers before.

    Vertices on a cycle or behind one have no layer and so no place: they are left out, or strict raises ValueError.
    """
    if strict and not layers.where("layer IS NULL").isEmpty():
        raise ValueError("the graph has a cycle")
    sizes = layers.where("layer IS NOT NULL").groupBy("layer").agg(F.count("*").alias("n"))
    before = sizes.select("layer", (F.sum("n").over(W.orderBy("layer").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    placed = ranked(layers.where("layer IS NOT NULL").select("v", "layer"), "layer", ["v"], "r")
    return placed.join(before, "layer").select("v", "layer", (F.col("before") + F.col("r")).alias("position"))


def order_violations(edges: DataFrame, order: DataFrame) -> DataFrame:
    """Edges whose source does not come before their target."""
    a = order.select(F.col("v").alias("src"), F.col("position").alias("p"))
    b = order.select(F.col("v").alias("dst"), F.col("position").alias("q"))
    return edges.join(a, "src").join(b, "dst").where("p >= q").select("src", "dst")


def layer_violations(edges: DataFrame, layers: DataFrame) -> DataFrame:
    """Edges that do not lead to a higher layer."""
    a = layers.select(F.col("v").alias("src"), F.col("layer").alias("src_layer"))
    b = layers.select(F.col("v").alias("dst"), F.col("layer").alias("dst_layer"))
    return edges.join(a, "src").join(b, "dst").where("src_layer >= dst_layer").select("src", "dst", "src_layer", "dst_layer")


def layer_distribution(layers: DataFrame) -> DataFrame:
    """(layer, n, share) of the layered vertices."""
    counts = layers.where("layer IS NOT NULL").groupBy("layer").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("layer", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def same_layer_edges(edges: DataFrame, layers: DataFrame) -> DataFrame:
    """Edges inside a layer, turned so that the smaller id is the source, and whether that turned them."""
    a = layers.select(F.col("v").alias("src"), F.col("layer").alias("layer"))
    b = layers.select(F.col("v").alias("dst"), F.col("layer").alias("dst_layer"))
    found = edges.join(a, "src").join(b, "dst").where("layer = dst_layer")
    return found.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "layer", (F.col("src") > F.col("dst")).alias("turned"))


def forward_edges(edges: DataFrame, placed: DataFrame) -> DataFrame:
    """Edges that go up in (layer, level); placed: v, layer, level."""
    a = placed.select(F.col("v").alias("src"), F.struct("layer", "level").alias("a"))
    b = placed.select(F.col("v").alias("dst"), F.struct("layer", "level").alias("b"))
    return edges.join(a, "src").join(b, "dst").where("a < b").select("src", "dst")


def isolated(all_vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices without an edge."""
    return all_vertices.join(edges.select(F.col("src").alias("v")), "v", "left_anti").join(edges.select(F.col("dst").alias("v")), "v", "left_anti")


def graph_statistics(edges: DataFrame) -> DataFrame:
    """One row: vertices, edges, mean degrees, density, largest degrees."""
    return degrees(edges).agg(F.count("*").alias("vertices"), F.sum("out_degree").alias("edges"), F.max("out_degree").alias("max_out"), F.max("in_degree").alias("max_in")).select(
        "vertices", "edges", "max_out", "max_in",
        F.round(F.col("edges") / F.col("vertices"), 6).alias("mean_out"),
        F.round(2 * F.col("edges") / F.col("vertices"), 6).alias("mean_degree"),
        F.round(F.when(F.col("vertices") > 1, F.col("edges") / (F.col("vertices") * (F.col("vertices") - 1.0))).otherwise(0.0), 9).alias("density"),
    )


def graph_report(edges: DataFrame, all_vertices: DataFrame) -> DataFrame:
    """One row over all vertices (v) and edges: vertices, isolated ones, components (each isolated vertex is one), size and share in percent of the largest, mean out and in degree, is_dag.

    The mean degrees are over vertices with an edge, and null without any.
    """
    edges = written(edges.select("src", "dst"), "edges")
    alone = isolated(all_vertices.select("v").distinct(), edges).agg(F.count("*").alias("isolated"))
    sizes = component_sizes(edges).agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("connected"), F.max("size").alias("m"))
    means = degrees(edges).agg(F.round(F.avg("out_degree"), 6).alias("mean_out"), F.round(F.avg("in_degree"), 6).alias("mean_in"))
    acyclic = is_dag(assign_layers(edges)).select("is_dag")
    row = alone.crossJoin(sizes).crossJoin(means).crossJoin(acyclic)  # four tables of one row
    total = F.col("isolated") + F.col("connected")
    largest = F.coalesce("m", F.when(F.col("isolated") > 0, 1).otherwise(0))
    return row.select(total.alias("vertices"), "isolated", (F.col("n") + F.col("isolated")).alias("components"), largest.cast("long").alias("largest"), F.when(total > 0, F.round(100.0 * largest / total, 4)).alias("largest_percent"), "mean_out", "mean_in", "is_dag")


def without_coordinates(placed: DataFrame, gone: DataFrame) -> DataFrame:
    """Positions (v, ...) whose other columns are null for the vertices in gone (v), as for isolated ones."""
    marked = placed.join(gone.select("v", F.lit(True).alias("_gone")).distinct(), "v", "left")
    return marked.select("v", *(F.when(F.col("_gone").isNull(), F.col(c)).alias(c) for c in placed.columns if c != "v"))


def reachable(edges: DataFrame, start: DataFrame, max_hops: int = 100_000) -> DataFrame:
    """(start, v, hops) with the fewest hops from each start to every vertex it reaches, itself with 0."""
    edges = edges.select("src", "dst")
    front = start.select(F.col("v").alias("start"), "v", F.lit(0).alias("hops")).distinct()
    seen = front = written(front, "front")
    for k in range(max_hops):
        step = front.join(edges, front.v == edges.src).select("start", F.col("dst").alias("v")).distinct()
        front = written(step.join(seen, ["start", "v"], "left_anti").withColumn("hops", F.lit(k + 1)), "front")
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
        if k % 8 == 7:  # what was found is read from its own files, and joined into one table now and then
            seen = written(seen, "seen")
    raise RuntimeError(f"more than {max_hops} hops")


def ancestors(edges: DataFrame, goals: DataFrame, max_hops: int = 100_000) -> DataFrame:
    """(start, v, hops) against the direction of the edges."""
    return reachable(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), goals, max_hops)


def longest_path(edges: DataFrame, layers: DataFrame) -> DataFrame:
    """(position, v) of one longest path; at every tie the smallest id."""
    layered = written(layers.where("layer IS NOT NULL"), "layered")
    a = layered.select(F.col("v").alias("src"), F.col("layer").alias("a"))
    b = layered.select(F.col("v").alias("dst"), F.col("layer").alias("b"))
    before = written(edges.join(a, "src").join(b, "dst").where("b = a + 1").groupBy("dst").agg(F.min("src").alias("src")), "before")
    end = layered.agg(F.max(F.struct("layer", F.lit(0))).alias("m")).select("m.layer").first()[0]
    if end is None:
        return layered.select(F.col("layer").alias("position"), "v")
    at = layered.where(F.col("layer") == end).agg(F.min("v")).first()[0]
    path = [at]
    while (step := before.where(F.col("dst") == path[-1]).first()) is not None:  # as many lookups as the path is long
        path.append(step["src"])
    return edges.sparkSession.createDataFrame([(k, v) for k, v in enumerate(reversed(path))], "position int, v string")


def merge_duplicate_vertices(actions: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges re-pointed to the smallest id of equal (subject, verb, object), lower-cased and trimmed; of parallel edges the most confident stays."""
    key = [F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in ("subject", "verb", "object")]
    canonical = actions.select("id", F.min("id").over(W.partitionBy(*key)).alias("to"))
    a, b = canonical.toDF("src", "s"), canonical.toDF("dst", "d")
    moved = edges.join(a, "src").join(b, "dst").where("s <> d")
    best = moved.groupBy("s", "d").agg(F.max(F.struct("confidence", "relation")).alias("m"))
    return best.select(F.col("s").alias("src"), F.col("d").alias("dst"), F.col("m.relation").alias("relation"), F.col("m.confidence").alias("confidence"))


def cyclic_core(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """Edges between vertices that lie on a cycle or between two cycles: ends without a way on are peeled from both sides."""
    left = written(edges, "core")
    n = left.count()
    for _ in range(max_rounds):
        kept = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        left = written(kept.select(*edges.columns), "core")
        after = left.count()
        if after == n:
            return left
        n = after
    raise RuntimeError(f"the core did not settle in {max_rounds} rounds")


def strong_components(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(v, component) of vertices that lie on a cycle, some of its components at least: those whose largest vertex reaches no larger one's component.

    Every vertex takes the largest id that reaches it. The vertices of one such colour that reach the
    vertex they are named by make a strongly connected component.
    """
    edges = edges.select("src", "dst")
    colour = written(vertices(edges).select("v", F.col("v").alias("c")), "colour")
    for _ in range(max_rounds):
        come = edges.join(colour.withColumnRenamed("v", "src"), "src").groupBy(F.col("dst").alias("v")).agg(F.max("c").alias("n"))
        new = written(colour.join(come, "v", "left").select("v", F.greatest("c", F.coalesce("n", "c")).alias("c"), (F.coalesce("n", "c") > F.col("c")).alias("moved")), "colour")
        colour = new.select("v", "c")
        if new.where("moved").isEmpty():
            break
    inside = written(edges.join(colour.toDF("src", "c"), "src").join(colour.toDF("dst", "d"), "dst").where("c = d").select("src", "dst", "c"), "inside")
    found = front = written(colour.where("v = c"), "front")
    for _ in range(max_rounds):
        step = front.select(F.col("v").alias("dst"), "c").join(inside, ["dst", "c"]).select(F.col("src").alias("v"), "c").distinct()
        front = written(step.join(found, ["v", "c"], "left_anti"), "front")
        if front.isEmpty():
            break
        found = written(found.unionByName(front), "found")
    return found.select("v", F.col("c").alias("component"))


def break_cycles(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """Edges (src, dst, confidence, ...) without cycles: of each strongly connected component the edge of least (confidence, src, dst) goes, until no cycle is left.

    Edges that lie on no cycle all stay. A round looks at the cyclic core alone and takes an edge from
    each component that it finds; these edges, as many as components, are not sent through the driver.
    """
    left = written(edges.where("src <> dst"), "edges")
    for _ in range(max_rounds):
        core = cyclic_core(left)
        if core.isEmpty():
            return left
        named = strong_components(core)
        own = core.join(named.toDF("src", "a").hint("merge"), "src").join(named.toDF("dst", "b").hint("merge"), "dst").where("a = b")
        worst = own.groupBy("a").agg(F.min(F.struct("confidence", "src", "dst")).alias("w")).select("w.src", "w.dst")
        left = written(left.join(worst.hint("merge"), ["src", "dst"], "left_anti").select(*edges.columns), "edges")
    raise RuntimeError(f"cycles are left after {max_rounds} rounds")


def simple_paths(edges: DataFrame, starts: DataFrame, cutoff: int = 10, per_start: int | None = None) -> DataFrame:
    """(start, path, confidence, complete, capped): paths from each start that can't be made longer, or that the cutoff ends (complete is false); mean confidence of their edges.

    The number of paths can grow without bound. per_start, if given, keeps so many paths of a start in a
    round, the most confident; capped then says whether any were left out.
    """
    # sort-merge joins: a broadcast in each round would send the edges through the driver again and again
    step = edges.select("src", "dst", F.col("confidence").alias("_c")).hint("merge")
    open_ = written(starts.select(F.col("v").alias("start"), F.array("v").alias("path"), F.lit(0.0).alias("sum"), F.lit(False).alias("capped")).distinct(), "paths")
    ended = []
    for _ in range(cutoff):
        more = open_.withColumn("_t", F.element_at("path", -1)).join(step, F.col("_t") == F.col("src"), "left").withColumn("_on", F.coalesce(~F.array_contains("path", F.col("dst")), F.lit(False)))
        grown = written(more.where("_on").select("start", F.concat("path", F.array("dst")).alias("path"), (F.col("sum") + F.col("_c")).alias("sum"), "capped"), "grown")
        done = more.groupBy("start", "path", "sum", "capped").agg(F.max("_on").alias("_on")).where("NOT _on").drop("_on")
        ended.append(written(done.withColumn("complete", F.lit(True)), "done"))
        if per_start is not None:
            rank = W.partitionBy("start")
            grown = grown.withColumn("_r", F.row_number().over(rank.orderBy(F.desc("sum"), "path"))).withColumn("_n", F.count("*").over(rank))
            grown = written(grown.where(F.col("_r") <= per_start).select("start", "path", "sum", (F.col("capped") | (F.col("_n") > per_start)).alias("capped")), "paths")
        open_ = grown
        if open_.isEmpty():
            break
    out = open_.withColumn("complete", F.lit(False))
    for part in ended:
        out = out.unionByName(part)
    return out.where(F.size("path") > 1).select("start", "path", F.round(F.col("sum") / (F.size("path") - 1), 6).alias("confidence"), "complete", "capped")


def paths_between(edges: DataFrame, pairs: DataFrame, cutoff: int = 10) -> DataFrame:
    """(start, goal, path) of all simple paths of at most `cutoff` edges from the start to the goal of distinct pairs; edges: src, dst.

    The hops that still lead from a vertex to a goal are found first, against the edges, so a path is only
    made longer where it can come to its goal in the steps that are left. There can be very many paths
    in a graph that is dense; `paths.best_paths` keeps the best. A start that is its goal has the path of one vertex.
    """
    edges = written(edges.select("src", "dst").where("src <> dst").distinct(), "edges")
    pairs = written(pairs.select("start", "goal").where("start IS NOT NULL AND goal IS NOT NULL").distinct(), "pairs")
    back = left = written(pairs.select("goal", F.col("goal").alias("v"), F.lit(0).alias("left")).distinct(), "left")
    for k in range(1, cutoff + 1):
        step = back.join(edges, back.v == edges.dst).select("goal", F.col("src").alias("v")).distinct().join(left, ["goal", "v"], "left_anti")
        back = written(step.withColumn("left", F.lit(k)), "left")
        if back.isEmpty():
            break
        left = left.unionByName(back)
    left = written(left, "left")
    open_ = written(pairs.join(left.withColumnRenamed("v", "start"), ["start", "goal"], "left_semi").withColumn("path", F.array("start")), "paths")
    done = open_.where("start = goal")
    for k in range(1, cutoff + 1):
        on = open_.where(F.element_at("path", -1) != F.col("goal")).withColumn("src", F.element_at("path", -1)).join(edges, "src").where(~F.array_contains("path", F.col("dst")))
        near = left.select("goal", F.col("v").alias("dst"), "left")
        open_ = written(on.join(near, ["goal", "dst"]).where(F.col("left") <= cutoff - k).select("start", "goal", F.concat("path", F.array("dst")).alias("path")), "paths")
        if open_.isEmpty():
            break
        done = done.unionByName(open_.where(F.element_at("path", -1) == F.col("goal")))
    return done


def path_statistics(path: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of a path (position, v): vertices, first and last, steps that are no edge, and whether it is a path."""
    steps = path.select(F.col("v").alias("src"), F.lead("v").over(W.orderBy("position")).alias("dst")).where("dst IS NOT NULL")
    missing = steps.join(edges.select("src", "dst"), ["src", "dst"], "left_anti").agg(F.count("*").alias("broken"))
    ends = path.agg(F.count("*").alias("length"), F.min_by("v", "position").alias("first"), F.max_by("v", "position").alias("last"))
    return ends.crossJoin(missing).select("length", "first", "last", "broken", (F.col("broken") == 0).alias("valid"))
