"""Which vertices reach which, answered from small labels where they suffice and by a search from both ends where they do not.

The label of a vertex holds the `size` smallest of the vertices that it reaches, itself included, in the
order of a hash (an independent permutation of the vertices). A label with fewer entries is the whole
set. One that is full tells for every vertex below its last entry whether it is in the set, and a
vertex whose own label has an entry below that bound that is missing can't be in the set either. Only
pairs that pass all these tests are searched for. Labels are made for the edges that lie on a way from
some start to some goal: no other edge can matter, and mostly these are few.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from inkgraph.operators import graph
from inkgraph.plans.scratch import written


def _crossed(edges: DataFrame, ends: DataFrame, max_rounds: int) -> DataFrame:
    """The edges (src, dst), which come from `graph.dealt_edges`, that a walk from any of ends (v) crosses. An edge is written once, in the round after its source is met."""
    none = edges.limit(0)
    crossed, met, front = [], [], ends
    for _ in range(max_rounds):
        rows = written(edges.join(front.withColumnRenamed("v", "src"), "src", "left_semi"), "crossed")
        _push(crossed, rows, "crossed")
        _push(met, front, "met")
        front = rows.select(F.col("dst").alias("v")).distinct()
        for _, part in met:
            front = front.join(part, "v", "left_anti")
        front = written(front, "front")
        if front.isEmpty():
            return reduce(DataFrame.unionByName, (part for _, part in crossed), none)
    raise RuntimeError(f"vertices are met for the first time after {max_rounds} rounds")


def _push(parts: list[tuple[int, DataFrame]], rows: DataFrame, name: str) -> None:
    """Adds rows to a list of (level, rows). Two of one level become one of the next, so n rounds leave log n parts, and a row is rewritten as often at most."""
    level = 0
    while parts and parts[-1][0] == level:
        rows, level = written(parts.pop()[1].unionByName(rows), name), level + 1
    parts.append((level, rows))


def edges_between(edges: DataFrame, starts: DataFrame, goals: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """The distinct edges (src, dst) on walks from a vertex of starts (v) to one of goals (v); both without repeats. Edges are shuffled once; those that lead to no goal go before anything is sought from the starts."""
    turned = graph.dealt_edges(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    back = _crossed(turned, goals, max_rounds)
    return _crossed(graph.dealt_edges(back.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), starts, max_rounds)


def _entry(v: str) -> Column:
    return F.struct(F.xxhash64(v).alias("h"), F.col(v).alias("v"))


def _smallest(rows: DataFrame, size: int) -> DataFrame:
    """(v, label) of rows (v, e): repeats go, and every task keeps `size` entries of a vertex before they are moved."""
    order = W.partitionBy("v").orderBy("e")
    kept = rows.distinct().withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= size)
    return kept.groupBy("v").agg(F.array_sort(F.collect_list("e")).alias("label"))


def reach_labels(edges: DataFrame, size: int = 8, max_rounds: int = 10_000) -> DataFrame:
    """(v, label) of all ends of edges (src, dst). Cycles, loops and repeats do no harm; edges with a null end are left out.

    A round passes on the labels that the round before has changed, and ends when none has; rounds are
    at most as many as the longest of the shortest paths has edges.
    """
    edges = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("v")).distinct()
    labels = changed = written(ends.select("v", F.array(_entry("v")).alias("label")), "labels")
    for _ in range(max_rounds):
        come = edges.join(changed.withColumnRenamed("v", "dst"), "dst").select(F.col("src").alias("v"), F.explode("label").alias("e"))
        new = _smallest(come, size).withColumnRenamed("label", "new")
        merged = F.slice(F.array_sort(F.array_union("label", "new")), 1, size)
        state = labels.join(new, "v", "left").select("v", F.when(F.col("new").isNull(), F.col("label")).otherwise(merged).alias("label"), F.coalesce(merged != F.col("label"), F.lit(False)).alias("changed"))
        state = written(state, "labels")
        labels, changed = state.select("v", "label"), state.where("changed").select("v", "label")
        if changed.isEmpty():
            return labels
    raise RuntimeError(f"labels still change after {max_rounds} rounds")


def may_reach(a: str, b: str, to: str, size: int) -> Column:
    """True or false where the labels in columns a and b tell whether a's vertex reaches the vertex in column `to`, which is b's; null where they don't."""
    entry, last = _entry(to), F.element_at(a, -1)
    lacking = F.exists(F.col(b), lambda e: (e <= last) & ~F.array_contains(F.col(a), e))
    return F.when(F.array_contains(a, entry), True).when((F.size(a) < size) | (entry < last) | lacking, False)


def label_answers(pairs: DataFrame, labels: DataFrame, size: int = 8) -> DataFrame:
    """(start, goal, answer) of distinct pairs: whether start reaches goal, null where labels of this size do not tell. A vertex reaches itself; one without edges no other."""
    a, b = labels.select(F.col("v").alias("start"), F.col("label").alias("_a")), labels.select(F.col("v").alias("goal"), F.col("label").alias("_b"))
    known = pairs.select("start", "goal").distinct().join(a, "start", "left").join(b, "goal", "left")
    none = F.col("_a").isNull() | F.col("_b").isNull()
    return known.select("start", "goal", F.when(F.col("start") == F.col("goal"), True).when(none, False).otherwise(may_reach("_a", "_b", "goal", size)).alias("answer"))


def reaching_pairs(edges: DataFrame, pairs: DataFrame, size: int = 8, max_rounds: int = 10_000) -> DataFrame:
    """The distinct pairs (start, goal) whose start reaches its goal over edges (src, dst), by any number of steps, none included.

    Pairs that labels leave open go on by a step from either end in a round; a step is kept only where
    labels can't tell that it leads nowhere. A pair ends when a label says yes, when both ends meet or
    when one end has no way on. Rows with a null are left out.
    """
    pairs = written(pairs.select("start", "goal").where("start IS NOT NULL AND goal IS NOT NULL").distinct(), "pairs")
    starts, goals = (written(pairs.select(F.col(c).alias("v")).distinct(), "ends") for c in ("start", "goal"))
    edges = edges_between(edges.where("src IS NOT NULL AND dst IS NOT NULL"), starts, goals, max_rounds)
    labels = reach_labels(edges, size)
    told = written(label_answers(pairs, labels, size), "answers")
    found = told.where("answer").select("start", "goal")
    open_ = told.where("answer IS NULL").select("start", "goal")
    sides = {"start": open_.withColumn("v", F.col("start")), "goal": open_.withColumn("v", F.col("goal"))}
    seen = dict(sides)
    for _ in range(max_rounds):
        if open_.isEmpty():
            return found
        yes = []
        for side, (here, there) in {"start": ("src", "dst"), "goal": ("dst", "src")}.items():
            front = sides[side].join(open_, ["start", "goal"], "left_semi")
            step = front.join(edges, front.v == F.col(here)).select("start", "goal", F.col(there).alias("v")).distinct().join(seen[side], ["start", "goal", "v"], "left_anti")
            a, b = ("v", "goal") if side == "start" else ("start", "v")
            of = lambda c, name: labels.select(F.col("v").alias(c), F.col("label").alias(name))
            tested = written(step.join(of(a, "_a"), a).join(of(b, "_b"), b).select("start", "goal", "v", may_reach("_a", "_b", b, size).alias("answer")), "steps")
            yes.append(tested.where("answer").select("start", "goal"))
            sides[side] = tested.where("answer IS NULL").select("start", "goal", "v")
            seen[side] = written(seen[side].unionByName(sides[side]).join(open_, ["start", "goal"], "left_semi"), "seen")
        meet = seen["start"].join(seen["goal"], ["start", "goal", "v"], "left_semi").select("start", "goal")
        new = written(yes[0].unionByName(yes[1]).unionByName(meet).distinct(), "met")
        found = found.unionByName(new)
        alive = open_.join(new, ["start", "goal"], "left_anti")
        for side in sides.values():
            alive = alive.join(side, ["start", "goal"], "left_semi")
        open_ = written(alive, "open")
    raise RuntimeError(f"pairs are open after {max_rounds} rounds")


def would_close_cycle(edges: DataFrame, new_edges: DataFrame, size: int = 8) -> DataFrame:
    """The new edges (src, dst) whose source can be reached from their target, or is it; repeats and other columns stay, edges with a null end don't."""
    found = reaching_pairs(edges, new_edges.select(F.col("dst").alias("start"), F.col("src").alias("goal")), size)
    return new_edges.join(found.select(F.col("goal").alias("src"), F.col("start").alias("dst")), ["src", "dst"], "left_semi")


def accepted_links(edges: DataFrame, new_edges: DataFrame, size: int = 8) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) of new edges, each tested against edges alone: refused ones would close a cycle or have a null end."""
    new_edges = written(new_edges, "new")
    refused = written(would_close_cycle(edges, new_edges, size), "refused")
    nulls = new_edges.where("src IS NULL OR dst IS NULL")
    kept = new_edges.where("src IS NOT NULL AND dst IS NOT NULL").join(refused.select("src", "dst"), ["src", "dst"], "left_anti")
    return kept.select(*new_edges.columns), refused.select(*new_edges.columns).unionByName(nulls)
