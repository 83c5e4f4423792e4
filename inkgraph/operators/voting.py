"""Voting between annotators: clusters of overlapping spans, agreement measures, combined confidences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window as W


def cluster_tokens(tokens: DataFrame, iou: float = 0.5) -> DataFrame:
    """Adds cluster: the first free span of a document, by (start, end, processor), is a seed and takes all free spans that overlap it by iou or more.

    Spans that no overlap connects cannot meet in a cluster, so a document falls into islands first, by
    a running maximum of ends. Most islands are settled at once: all their spans overlap the first by iou
    or more. The order matters inside the others alone, where the spans are folded. The tokens are dealt by
    document once, and what follows by document and cluster needs no other shuffle.
    """
    order = W.partitionBy("doc_id").orderBy("start", "end", "processor", "idx")
    ahead = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    islands = tokens.withColumn("_new", F.when(F.col("start") < ahead, 0).otherwise(1)).withColumn("_island", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    names = ["start", "end", "processor", "idx", "text", "pos", "confidence"]
    grouped = islands.groupBy("doc_id", "_island").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("s"))
    kind = "array<struct<start:bigint,end:bigint,cluster:int>>"

    def overlap(a: Column, b: Column) -> Column:
        both = F.greatest(F.lit(0), F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"]))
        return both / (F.greatest(a["end"], b["end"]) - F.least(a["start"], b["start"]))

    # open: seeds that later spans may still join, each with its number; out: the cluster of each span
    init = F.struct(F.array().cast(kind).alias("open"), F.lit(0).alias("next"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        alive = F.filter(acc["open"], lambda o: o["end"] > x["start"])
        mine = F.filter(alive, lambda o: overlap(o, x) >= iou)
        joins = F.size(mine) > 0
        number = F.when(joins, F.get(mine, F.lit(0))["cluster"]).otherwise(acc["next"])
        seed = F.array(F.struct(x["start"].cast("bigint").alias("start"), x["end"].cast("bigint").alias("end"), acc["next"].alias("cluster")))
        return F.struct(F.when(joins, alive).otherwise(F.concat(alive, seed)).alias("open"), F.when(joins, acc["next"]).otherwise(acc["next"] + 1).alias("next"), F.concat(acc["out"], F.array(number)).alias("out"))

    first = F.get("s", F.lit(0))
    one = F.coalesce(F.forall("s", lambda x: overlap(first, x) >= iou), F.lit(False))
    number = F.when(one, F.transform("s", lambda x: F.lit(0))).otherwise(F.aggregate("s", init, step, lambda acc: acc["out"]))
    rows = grouped.withColumn("c", number).select("doc_id", "_island", F.explode(F.arrays_zip("s", "c")).alias("x"))
    return rows.select("doc_id", F.concat_ws(".", "_island", "x.c").alias("cluster"), "x.s.*")


def vote_tokens(clustered: DataFrame, min_agreement: int = 2) -> DataFrame:
    """(doc_id, cluster, start, end, text, pos, votes, confidence, agreed): the part of speech with most processors, ties by confidence and name."""
    votes = clustered.groupBy("doc_id", "cluster", "pos").agg(F.countDistinct("processor").alias("votes"), F.avg("confidence").alias("confidence"), F.min(F.struct("start", "end", "processor", "text")).alias("first"))
    best = votes.withColumn("r", F.row_number().over(W.partitionBy("doc_id", "cluster").orderBy(F.desc("votes"), F.desc("confidence"), "pos"))).where("r = 1")
    return best.select("doc_id", "cluster", "first.start", "first.end", "first.text", "pos", "votes", F.round("confidence", 6).alias("confidence"), (F.col("votes") >= min_agreement).alias("agreed"))


def agreement_rate(voted: DataFrame) -> DataFrame:
    return voted.agg(F.count("*").alias("clusters"), F.count(F.when(F.col("agreed"), 1)).alias("agreed")).withColumn("rate", F.when(F.col("clusters") > 0, F.round(F.col("agreed") / F.col("clusters"), 6)).otherwise(0.0))


def pairwise_jaccard(items: DataFrame) -> DataFrame:
    """(a, b, jaccard) between the distinct items of each two processors; items: processor and other columns that name an item."""
    keys = [c for c in items.columns if c != "processor"]
    raters = items.distinct().groupBy(*keys).agg(F.array_sort(F.collect_set("processor")).alias("p"))  # as many as there are processors
    sizes = raters.select(F.explode("p").alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    pairs = raters.select(F.explode(F.flatten(F.transform("p", lambda a: F.transform(F.filter("p", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("x")).select("x.*").groupBy("a", "b").agg(F.count("*").alias("both"))
    names = sizes.select("p").alias("x").join(sizes.select("p").alias("y"), F.col("x.p") < F.col("y.p")).select(F.col("x.p").alias("a"), F.col("y.p").alias("b"))
    joined = names.join(pairs, ["a", "b"], "left").join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b").na.fill(0, ["both"])
    return joined.select("a", "b", F.round(F.col("both") / (F.col("na") + F.col("nb") - F.col("both")), 6).alias("jaccard"))


def _cells(ratings: DataFrame) -> DataFrame:
    return ratings.where("category IS NOT NULL").groupBy("item", "category").agg(F.count("*").alias("n"))


def fleiss_kappa(ratings: DataFrame) -> DataFrame:
    """One row of items, raters and kappa from (item, rater, category); every item has as many ratings."""
    cells = _cells(ratings)
    items = cells.groupBy("item").agg(F.sum("n").alias("m"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same")).where("m > 1")
    observed = items.agg(F.count("*").alias("items"), F.max("m").alias("raters"), F.avg(F.col("same") / (F.col("m") * (F.col("m") - 1))).alias("po"))
    expected = cells.groupBy("category").agg(F.sum("n").alias("n")).agg((F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("pe"))
    return observed.crossJoin(expected).select("items", "raters", F.round(F.when(F.col("pe") >= 1, 1.0).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe"))), 6).alias("kappa"))


def cohen_kappa(ratings: DataFrame, first: str, second: str) -> DataFrame:
    """One row: items that both have rated, and kappa."""
    a = ratings.where(F.col("rater") == first).select("item", F.col("category").alias("a"))
    b = ratings.where(F.col("rater") == second).select("item", F.col("category").alias("b"))
    cells = a.join(b, "item").where("a IS NOT NULL AND b IS NOT NULL").groupBy("a", "b").agg(F.count("*").alias("n"))
    both = cells.agg(F.sum("n").alias("items"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    left, right = cells.groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("x")), cells.groupBy(F.col("b").alias("c")).agg(F.sum("n").alias("y"))
    chance = left.join(right, "c").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("chance"))
    po, pe = F.col("same") / F.col("items"), F.col("chance") / (F.col("items") * F.col("items"))
    return both.crossJoin(chance).select("items", F.round(F.when(pe >= 1, 1.0).otherwise((po - pe) / (1 - pe)), 6).alias("kappa"))


def krippendorff_alpha(ratings: DataFrame) -> DataFrame:
    """Nominal alpha with missing ratings: disagreeing pairs of an item against those of all ratings."""
    cells = _cells(ratings)
    items = cells.groupBy("item").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("s")).where("m > 1")
    observed = items.agg((F.sum(F.col("m") * F.col("m") - F.col("s")) / F.sum(F.col("m") * (F.col("m") - 1))).alias("do"))
    expected = cells.groupBy("category").agg(F.sum("n").alias("n")).agg((1 - F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("de"))
    return observed.crossJoin(expected).select(F.round(F.when(F.col("de") > 0, 1 - F.col("do") / F.col("de")).otherwise(1.0), 6).alias("alpha"))


def interpretation(kappa: Column) -> Column:
    """Fixed bands of agreement."""
    return F.when(kappa < 0, "poor").when(kappa <= 0.2, "slight").when(kappa <= 0.4, "fair").when(kappa <= 0.6, "moderate").when(kappa <= 0.8, "substantial").otherwise("almost perfect")


def combined_confidence(rows: DataFrame, keys: list[str], value: str = "confidence", weight: str = "weight") -> DataFrame:
    """All ways to combine the confidences of a group: means, extremes, product, noisy or, median, agreement bonus."""
    x, w = F.col(value), F.col(weight)
    return rows.groupBy(*keys).agg(
        F.round(F.avg(x), 6).alias("mean"),
        F.round(F.sum(x * w) / F.sum(w), 6).alias("weighted"),
        F.round(F.min(x), 6).alias("least"),
        F.round(F.max(x), 6).alias("most"),
        F.round(F.count(F.when(x > 0, 1)) / F.sum(F.when(x > 0, 1 / x)), 6).alias("harmonic"),
        F.round(F.product(x), 6).alias("product"),
        F.round(1 - F.product(1 - x), 6).alias("noisy_or"),
        F.round(F.median(x), 6).alias("median"),
        F.round(F.least(F.lit(1.0), F.avg(x) + 0.1 * (F.count(x) - 1)), 6).alias("with_bonus"),
    )


def best_of_duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key, the most confident, ties by processor."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("confidence"), "processor"))).where("_r = 1").drop("_r")


def vote_dependencies(deps: DataFrame, preferred: str, min_agreement: int = 2) -> DataFrame:
    """(doc_id, head, dependent, relation, votes): the preferred processor's relation, else the base relation that enough processors share."""
    keys = ["doc_id", "head", "dependent"]
    base = F.split("relation", ":")[0]
    own = deps.where(F.col("processor") == preferred).groupBy(*keys).agg(F.max_by("relation", F.struct("confidence", "relation")).alias("relation")).withColumn("votes", F.lit(1).cast("long"))
    rest = deps.join(own, keys, "left_anti").withColumn("base", base)
    groups = rest.groupBy(*keys, "base").agg(F.countDistinct("processor").alias("votes"), F.avg("confidence").alias("sure"))
    best = groups.withColumn("r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("votes"), F.desc("sure"), "base"))).where((F.col("r") == 1) & (F.col("votes") >= min_agreement)).select(*keys, "base", "votes")
    full = rest.join(best, [*keys, "base"]).groupBy(*keys, "votes", "relation").agg(F.count("*").alias("n"))
    named = full.withColumn("r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n"), "relation"))).where("r = 1").select(*keys, "relation", "votes")
    return own.unionByName(named)


def merge_tokens(clustered: DataFrame) -> DataFrame:
    """(doc_id, cluster, text, pos, confidence, sources): the first token as base, majority part of speech, mean confidence, all processors."""
    pos = clustered.groupBy("doc_id", "cluster", "pos").agg(F.count("*").alias("n")).groupBy("doc_id", "cluster").agg(F.min(F.struct((-F.col("n")).alias("k"), "pos")).alias("p"))
    base = clustered.groupBy("doc_id", "cluster").agg(F.min(F.struct("start", "end", "processor", "text")).alias("f"), F.round(F.avg("confidence"), 6).alias("confidence"), F.array_join(F.array_sort(F.collect_set("processor")), ",").alias("sources"))
    return base.join(pos, ["doc_id", "cluster"]).select("doc_id", "cluster", "f.text", "p.pos", "confidence", "sources")


def merge_morph(rows: DataFrame, keys: list[str], min_agreement: int = 2) -> DataFrame:
    """(keys, morph): for each feature the value that most processors give, if enough do; ties by value."""
    pairs = rows.select(*keys, "processor", F.explode("morph").alias("feature", "value")).groupBy(*keys, "feature", "value").agg(F.countDistinct("processor").alias("n"))
    best = pairs.withColumn("r", F.row_number().over(W.partitionBy(*keys, "feature").orderBy(F.desc("n"), "value"))).where((F.col("r") == 1) & (F.col("n") >= min_agreement))
    return best.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "value")))).alias("morph"))


def vote_entities(entities: DataFrame, min_agreement: int = 2) -> DataFrame:
    """(doc_id, cluster, start, end, entity_type, votes) of clusters in which enough processors agree on the type; boundaries are means cut to integers."""
    clustered = cluster_tokens(entities.withColumnRenamed("entity_type", "pos"))
    votes = clustered.groupBy("doc_id", "cluster", "pos").agg(F.countDistinct("processor").alias("votes"))
    best = votes.withColumn("r", F.row_number().over(W.partitionBy("doc_id", "cluster").orderBy(F.desc("votes"), "pos"))).where((F.col("r") == 1) & (F.col("votes") >= min_agreement))
    spans = clustered.groupBy("doc_id", "cluster").agg(F.avg("start").cast("int").alias("start"), F.avg("end").cast("int").alias("end"))
    return best.join(spans, ["doc_id", "cluster"]).select("doc_id", "cluster", "start", "end", F.col("pos").alias("entity_type"), "votes")


def tokens_to_sentences(tokens: DataFrame, sentences: DataFrame) -> DataFrame:
    """(doc_id, idx, sent_idx): the sentence that a token begins in, by one sort of both tables; sentences: doc_id, sent_idx, start, end."""
    a = sentences.select("doc_id", F.col("start").cast("long").alias("at"), F.lit(0).alias("kind"), F.struct("sent_idx", F.col("end").cast("long").alias("end")).alias("x"), F.lit(None).cast("int").alias("idx"))
    b = tokens.select("doc_id", F.col("start").cast("long").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(a.schema["x"].dataType).alias("x"), F.col("idx").cast("int").alias("idx"))
    last = F.last("x", True).over(W.partitionBy("doc_id").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, 0))
    both = a.unionByName(b).withColumn("s", last).where("kind = 1")
    return both.select("doc_id", "idx", F.when(F.col("at") < F.col("s.end"), F.col("s.sent_idx")).alias("sent_idx"))


def overall_agreement(kinds: DataFrame) -> DataFrame:
    """One row from (kind, agreed, total): weights tokens 1, dependencies 2, entities 1.5; kinds without items are left out."""
    weight = F.when(F.col("kind") == "dependencies", 2.0).when(F.col("kind") == "entities", 1.5).otherwise(1.0)
    used = kinds.where("total > 0").withColumn("w", weight)
    return used.agg(F.round(F.coalesce(F.sum(F.col("w") * F.col("agreed") / F.col("total")) / F.sum("w"), F.lit(0.0)), 6).alias("agreement"))


def trimmed_means(rows: DataFrame, keys: list[str], share: float = 0.1, value: str = "confidence") -> DataFrame:
    """(keys, trimmed): the mean without the lowest and highest share of a group, counted down to whole rows."""
    w = W.partitionBy(*keys)
    placed = rows.where(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(w.orderBy(value))).withColumn("_n", F.count("*").over(w))
    cut = F.floor(F.col("_n") * share)
    return placed.where((F.col("_r") > cut) & (F.col("_r") <= F.col("_n") - cut)).groupBy(*keys).agg(F.round(F.avg(value), 6).alias("trimmed"))


def chained_spans(start: np.ndarray, end: np.ndarray, iou: float) -> np.ndarray:
    """For spans in order of (start, end) the place of the first span that a chain of overlaps of iou or more joins each with.

    A span is held against the ones behind it, nearest first, until one begins at its end or later: memory is that of the spans, however many overlap.
    """
    first = np.arange(len(start))

    def root(k: int) -> int:
        while first[k] != k:
            first[k] = k = first[first[k]]
        return k

    open_, lag = first.copy(), 0
    while len(open_):
        lag += 1
        open_ = open_[open_ + lag < len(start)]
        open_ = open_[start[open_ + lag] < end[open_]]
        other = open_ + lag
        both = np.minimum(end[open_], end[other]) - start[other]
        near = (both > 0) & (both / np.maximum(np.maximum(end[open_], end[other]) - start[open_], 1) >= iou)
        for a, b in zip(open_[near].tolist(), other[near].tolist(), strict=True):
            a, b = sorted((root(a), root(b)))
            first[b] = a
    return np.array([root(k) for k in range(len(first))], np.int64)


def cluster_entities(entities: DataFrame, iou: float = 0.5) -> DataFrame:
    """Entities (doc_id, start, end, ...) with cluster: spans belong together where a chain of overlaps of iou or more joins them.

    A document's spans are joined in one task, and no pairs of them are listed. The cluster is named by its first span. Entities without a document or a place have no row.
    """

    def joined(rows: pa.Table) -> pa.Table:
        start, end = (rows.column(c).combine_chunks().cast(pa.int64()).to_numpy() for c in ("start", "end"))
        order = np.lexsort((end, start))
        a, b = start[order], end[order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))  # equal spans are one
        heads = np.flatnonzero(new)
        first = np.empty(len(order), np.int64)
        first[order] = order[heads[chained_spans(a[heads], b[heads], iou)][np.cumsum(new) - 1]]
        return rows.append_column("_s", pa.array(start[first])).append_column("_e", pa.array(end[first]))

    known = entities.where("doc_id IS NOT NULL AND start IS NOT NULL AND end IS NOT NULL")
    schema = StructType([*known.schema.fields, StructField("_s", LongType()), StructField("_e", LongType())])
    name = F.format_string("%s:%012d:%012d", F.col("doc_id").cast("string"), "_s", "_e")
    return known.groupBy("doc_id").applyInArrow(joined, schema).withColumn("cluster", name).drop("_s", "_e")


def fan_out(documents: DataFrame, processors: dict) -> tuple[DataFrame | None, dict[str, str]]:
    """(rows of all processors, errors by name): each processor is a function from documents to rows; one that can't be planned is left out and named."""
    rows, failed = None, {}
    for name, make in processors.items():
        try:
            part = make(documents)
            part.schema  # noqa: B018
        except Exception as error:  # a processor is a user's function
            failed[name] = str(error).splitlines()[0][:200]
            continue
        part = part.withColumn("processor", F.lit(name))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    return rows, failed
