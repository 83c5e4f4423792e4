"""Layered layout: positions, routes and viewport queries over (v, layer) tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from inkgraph.operators.inversions import opposite_pairs
from inkgraph.operators.ranks import ranked


def place(layers: DataFrame, width: float = 200, height: float = 80, hgap: float = 40, vgap: float = 50) -> DataFrame:
    """(v, layer, level, x, y): level is the rank of the id in its layer."""
    out = ranked(layers.where("layer IS NOT NULL").select("v", "layer"), "layer", ["v"], "level")
    return out.select("v", "layer", "level", (F.col("layer") * F.lit(float(width + hgap))).alias("x"), (F.col("level") * F.lit(float(height + vgap))).alias("y"))


def place_centred(layers: DataFrame, step_x: float = 250, step_y: float = 130) -> DataFrame:
    """(v, x, y) with each layer centred on y = 0."""
    known = layers.where("layer IS NOT NULL").select("v", "layer")
    rows = ranked(known, "layer", ["v"], "r").join(known.groupBy("layer").agg(F.count("*").alias("n")), "layer")
    return rows.select("v", (F.col("layer") * F.lit(float(step_x))).alias("x"), (-(F.col("n") - 1) * F.lit(step_y / 2.0) + F.col("r") * F.lit(float(step_y))).alias("y"))


def compact(placed: DataFrame, step: float = 130) -> DataFrame:
    """Layers with a vertical gap over the step are spaced anew from 0; (v, layer, x, y)."""
    by_layer = W.partitionBy("layer")
    gaps = placed.withColumn("gap", F.col("y") - F.lag("y").over(by_layer.orderBy("y", "v")))
    wide = gaps.withColumn("wide", F.max(F.coalesce(F.col("gap") > step, F.lit(False))).over(by_layer))
    return wide.select("v", "layer", "x", F.when(F.col("wide"), (F.row_number().over(by_layer.orderBy("y", "v")) - 1) * F.lit(float(step))).otherwise(F.col("y")).alias("y"))


def next_free_slot(placed: DataFrame) -> DataFrame:
    """(layer, level): the lowest free level of each layer."""
    ranked = placed.select("layer", "level").distinct().withColumn("r", F.row_number().over(W.partitionBy("layer").orderBy("level")) - 1)
    return ranked.groupBy("layer").agg(F.coalesce(F.min(F.when(F.col("level") != F.col("r"), F.col("r"))), F.max("r") + 1).alias("level"))


def extent(placed: DataFrame, width: float = 200, height: float = 80) -> DataFrame:
    """One row: width and height of the drawing, vertices and layers, mean and largest layer."""
    per = placed.groupBy("layer").agg(F.count("*").alias("n"), F.max("x").alias("x"), F.max("y").alias("y"))
    return per.agg((F.max("x") + width).alias("width"), (F.max("y") + height).alias("height"), F.sum("n").alias("vertices"), F.count("*").alias("layers"), F.round(F.avg("n"), 6).alias("mean_per_layer"), F.max("n").alias("max_per_layer"))


def _ends(edges: DataFrame, placed: DataFrame) -> DataFrame:
    a = placed.select(F.col("v").alias("src"), F.col("layer").alias("src_layer"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = placed.select(F.col("v").alias("dst"), F.col("layer").alias("dst_layer"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return edges.select("src", "dst").join(a, "src").join(b, "dst")


def routes(edges: DataFrame, placed: DataFrame, width: float = 200, height: float = 80) -> DataFrame:
    """(src, dst, points): right middle to left middle, with evenly spaced points between where the edge spans two layers or more."""
    span = F.greatest(F.lit(1), F.abs(F.col("dst_layer") - F.col("src_layer")))
    start_x, start_y = F.col("x1") + float(width), F.col("y1") + height / 2.0
    dx, dy = F.col("x2") - start_x, F.col("y2") + height / 2.0 - start_y
    points = F.transform(F.sequence(F.lit(0), span), lambda k: F.struct((start_x + dx * k / span).alias("x"), (start_y + dy * k / span).alias("y")))
    return _ends(edges, placed).select("src", "dst", points.alias("points"))


def orthogonal_routes(edges: DataFrame, placed: DataFrame, width: float = 200, height: float = 80) -> DataFrame:
    """(src, dst, points): four points over the middle x."""
    x1, y1, x2, y2 = F.col("x1") + float(width), F.col("y1") + height / 2.0, F.col("x2"), F.col("y2") + height / 2.0
    mid = (x1 + x2) / 2
    return _ends(edges, placed).select("src", "dst", F.array(*(F.struct(a.alias("x"), b.alias("y")) for a, b in ((x1, y1), (mid, y1), (mid, y2), (x2, y2)))).alias("points"))


def route_lengths(routed: DataFrame) -> DataFrame:
    """(src, dst, waypoints, length)."""
    steps = F.transform(F.sequence(F.lit(1), F.size("points") - 1), lambda k: F.sqrt(F.pow(F.get("points", k).x - F.get("points", k - 1).x, 2) + F.pow(F.get("points", k).y - F.get("points", k - 1).y, 2)))
    return routed.select("src", "dst", (F.size("points") - 2).alias("waypoints"), F.round(F.aggregate(steps, F.lit(0.0), lambda a, b: a + b), 3).alias("length"))


def route_statistics(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count("*").alias("routes"), F.count(F.when(F.col("waypoints") == 0, 1)).alias("straight"), F.count(F.when(F.col("waypoints") > 0, 1)).alias("polylines"), F.round(F.avg("waypoints"), 6).alias("mean_waypoints"))


def laid_out_with_links(articles: DataFrame, edges: DataFrame) -> DataFrame:
    """Placed articles that have a link."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("v"))
    return articles.where("layer IS NOT NULL AND level IS NOT NULL").join(ends, "v", "left_semi")


def viewport_nodes(nodes: DataFrame, left: float, top: float, right: float, bottom: float) -> DataFrame:
    """Nodes in the rectangle; without coordinates of their own they stand at layer * 240, level * 130."""
    x, y = F.coalesce("x", F.col("layer") * 240.0), F.coalesce("y", F.col("level") * 130.0)
    return nodes.select("v", "layer", "level", x.alias("x"), y.alias("y")).where(F.col("x").between(left, right) & F.col("y").between(top, bottom))


def viewport_edges(edges: DataFrame, inside: DataFrame, most: int = 20) -> DataFrame:
    """Edges with an end in view, at most so many per node and direction in order of the other end."""
    seen = inside.select(F.col("v").alias("node"))
    out = edges.join(seen, F.col("src") == F.col("node")).withColumn("r", F.row_number().over(W.partitionBy("src").orderBy("dst")))
    into = edges.join(seen, F.col("dst") == F.col("node")).withColumn("r", F.row_number().over(W.partitionBy("dst").orderBy("src")))
    return out.where(F.col("r") <= most).select("src", "dst").union(into.where(F.col("r") <= most).select("src", "dst")).distinct()


def page_by_distance(nodes: DataFrame, x: float, y: float, offset: int, limit: int) -> DataFrame:
    """(v, distance): a page of the nodes nearest to a point, ties by layer and id."""
    distance = F.round(F.sqrt(F.pow(F.col("x") - x, 2) + F.pow(F.col("y") - y, 2)), 6)
    return nodes.select("v", "layer", distance.alias("distance")).orderBy("distance", "layer", "v").offset(offset).limit(limit).select("v", "distance")


def overlapping_blocks(blocks: DataFrame, left: float, top: float, right: float, bottom: float, overscan: int = 2, width: float = 200, height: float = 80) -> DataFrame:
    """Blocks that overlap the view and a margin of so many block sizes."""
    dx, dy = overscan * width, overscan * height
    return blocks.where((F.col("x") + width >= left - dx) & (F.col("x") <= right + dx) & (F.col("y") + height >= top - dy) & (F.col("y") <= bottom + dy))


def write_back(articles: DataFrame, placed: DataFrame) -> DataFrame:
    """Articles with new layer, level, x and y where placed has them."""
    new = placed.select("v", *(F.col(c).alias(f"_{c}") for c in ("layer", "level", "x", "y")))
    kept = [c for c in articles.columns if c not in ("layer", "level", "x", "y")]
    return articles.join(new, "v", "left").select(*kept, *(F.coalesce(f"_{c}", c).alias(c) for c in ("layer", "level", "x", "y")))


def level_bands(blocks: DataFrame, step: float = 130, margin: float = 40) -> DataFrame:
    """(level, n, top, height): bands below each other, as high as their number of sublevels asks for."""
    per = blocks.groupBy("level").agg(F.countDistinct("sublevel").alias("n"))
    high = per.withColumn("height", F.col("n") * float(step) + margin)
    return high.select("level", "n", (F.sum("height").over(W.orderBy("level").rowsBetween(W.unboundedPreceding, 0)) - F.col("height")).alias("top"), "height")


def virtual_sublevels(blocks: DataFrame, height: float = 520, step: float = 130) -> DataFrame:
    """(v, chunk): unpinned blocks of a sublevel in chunks of floor(height / step), pinned ones in chunk 0."""
    room = max(1, int(height // step))
    rank = F.row_number().over(W.partitionBy("sublevel", "is_pinned").orderBy("v")) - 1
    return blocks.select("v", F.when(F.col("is_pinned"), 0).otherwise(F.floor(rank / room)).cast("int").alias("chunk"))


def barycentre(edges: DataFrame, layers: DataFrame) -> DataFrame:
    """(v, layer, level): a vertex goes to the mean first place of its predecessors in lower and its successors in higher layers, or to half of its layer; ties by v.

    First places are by v. The published sweeps, three from left to right and back, layer by layer, sort each
    layer again and again by these scores; they take places from the order at the start, so the scores
    never change and one stable sort gives what all sweeps give. Neighbours in the same layer do not count, and
    neither do vertices without a layer, which have no row. Repeated edges count once.
    """
    from inkgraph.plans.scratch import written

    known = layers.where("layer IS NOT NULL").select("v", "layer")
    sizes = known.groupBy("layer").agg(F.count("*").alias("size"))
    first = written(ranked(known, "layer", ["v"], "place"), "places")
    a = first.select(F.col("v").alias("src"), F.col("layer").alias("src_layer"), F.col("place").alias("src_place"))
    b = first.select(F.col("v").alias("dst"), F.col("layer").alias("dst_layer"), F.col("place").alias("dst_place"))
    up = edges.select("src", "dst").distinct().join(a, "src").join(b, "dst").where("src_layer < dst_layer")
    both = F.array(F.struct(F.col("dst").alias("v"), F.col("src_place").alias("place")), F.struct(F.col("src").alias("v"), F.col("dst_place").alias("place")))
    mean = up.select(F.explode(both).alias("x")).groupBy("x.v").agg(F.avg("x.place").alias("mean"))
    # sizes has a row for each layer, and layers can be as many as vertices: no hint to broadcast it
    scored = first.join(mean, "v", "left").join(sizes, "layer").select("v", "layer", F.coalesce("mean", F.col("size") / 2.0).alias("score"))
    return ranked(scored, "layer", ["score", "v"], "level").drop("score")


def crossings(edges: DataFrame, placed: DataFrame) -> DataFrame:
    """(src_layer, dst_layer, crossings): pairs of edges of one pair of layers whose ends are in opposite order."""
    a = placed.select(F.col("v").alias("src"), F.col("layer").alias("src_layer"), F.col("level").cast("long").alias("p"))
    b = placed.select(F.col("v").alias("dst"), F.col("layer").alias("dst_layer"), F.col("level").cast("long").alias("q"))
    keys = ["src_layer", "dst_layer"]
    found = opposite_pairs(edges.select("src", "dst").join(a, "src").join(b, "dst"), keys, "p", "q")
    kind = placed.schema["layer"].dataType
    return found.select(*(F.col(k).cast(kind).alias(k) for k in keys), F.col("n").alias("crossings"))


def display_titles(blocks: DataFrame) -> DataFrame:
    """(uid, display): the title, else the name, the content, the uid."""
    return blocks.select("uid", F.coalesce("title", "name", "content", "uid").alias("display"))


def blocks_with_tags(blocks: DataFrame, tags: DataFrame) -> DataFrame:
    """Blocks with their tags (uid, tag) in order, joined by commas; empty without any."""
    own = tags.groupBy("uid").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))
    return blocks.join(own, "uid", "left").na.fill("", ["tags"])


def blocks_of_layer(blocks: DataFrame, layer: int) -> DataFrame:
    """Blocks (uid, layer, level, ...) of one layer."""
    return blocks.where(F.col("layer") == layer)


def blocks_of_users(blocks: DataFrame, owners: DataFrame) -> DataFrame:
    """(user, uid, ...) of blocks by their users; owners: user, uid. A user without a block and an owner of an unknown one give no row, a repeated owner one."""
    return owners.select("user", "uid").distinct().join(blocks, "uid").select("user", *blocks.columns)


def without_link(links: DataFrame, gone: DataFrame) -> DataFrame:
    """Links (uid, ...) without those whose uid is in gone (uid)."""
    return links.join(gone.select("uid").distinct(), "uid", "left_anti").select(*links.columns)


def without_blocks(gone: DataFrame, blocks: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks, links) without the blocks that go and all links at either of their ends."""
    g = gone.select("v")
    return blocks.join(g, "v", "left_anti"), links.join(g.withColumnRenamed("v", "src"), "src", "left_anti").join(g.withColumnRenamed("v", "dst"), "dst", "left_anti")


def with_pins(blocks: DataFrame, changes: DataFrame) -> DataFrame:
    """Blocks (v, level, is_pinned, scale) after a change table (v, pin, scale, level): pin or unpin, a scale with a pin, a level for blocks that are pinned; null leaves a value."""
    c = changes.select("v", F.col("pin").alias("_pin"), F.col("scale").alias("_scale"), F.col("level").alias("_level"))
    joined = blocks.join(c, "v", "left")
    pinned = F.coalesce("_pin", "is_pinned")
    return joined.select("v", F.when(pinned, F.coalesce("_level", "level")).otherwise(F.col("level")).alias("level"), pinned.alias("is_pinned"), F.when(pinned, F.coalesce("_scale", "scale")).otherwise(F.col("scale")).alias("scale"))


def page_boxes(boxes: DataFrame) -> DataFrame:
    """(uid, doc_id, page, bbox): the box as a struct, null where x is null."""
    return boxes.select("uid", "doc_id", "page", F.when(F.col("x").isNotNull(), F.struct("x", "y", "width", "height")).alias("bbox"))
