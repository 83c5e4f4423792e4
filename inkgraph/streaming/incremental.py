"""Structured Streaming forms: articles and edges that arrive as files, layers and articles kept up to date batch by batch.

What a batch changes is a segment of a log in a folder of its own; a table is read as the log's
segments together. Sixteen segments of one level are joined into one of the next level by the batch
that completes them, so a row is written again as often as the logarithm of the number of batches, a
table is read from at most 15 segments a level, and no batch copies all that was there before. Which
segments make a table follows from the number of the batch alone: a batch that is run again, after a
lost executor or from the checkpoint, writes over its own folders and reads those of earlier ones.
Segments that were joined stay until `remove_joined` is called.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkgraph.plans.scratch import written

#: Segments of one level that are joined into one of the next.
FAN = 16


def segments(batches: int, fan: int = FAN) -> list[tuple[int, int]]:
    """(level, place) of the segments that hold the first `batches` batches, oldest first; a segment of level l covers fan**l batches, from place * fan**l on."""
    out, level = [], 0
    while batches:
        batches, left = divmod(batches, fan)
        out = [(level, batches * fan + k) for k in range(left)] + out
        level += 1
    return out


def _path(folder: str, segment: tuple[int, int]) -> str:
    return f"{folder}/level-{segment[0]}/{segment[1]}"


def log_rows(spark: SparkSession, folder: str, schema: str, batches: int) -> DataFrame:
    """All rows of the log after so many batches."""
    parts = [spark.read.schema(schema).parquet(_path(folder, s)) for s in segments(batches)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def append_segment(rows: DataFrame, folder: str, schema: str, number: int, joined=lambda rows: rows) -> None:
    """Write the rows of batch `number`; where that completes sixteen segments, join them, by `joined` for logs of which a part is enough."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(_path(folder, (0, number)))
    level, place = 0, number
    while place % FAN == FAN - 1:
        parts = [spark.read.schema(schema).parquet(_path(folder, (level, place - k))) for k in range(FAN)]
        level, place = level + 1, place // FAN
        joined(reduce(DataFrame.unionByName, parts)).write.mode("overwrite").parquet(_path(folder, (level, place)))


def remove_joined(spark: SparkSession, folder: str, batches: int) -> int:
    """Remove segments that a larger one holds, as of so many finished batches; how many there were. Not for use while a batch runs or the log is read."""
    files, gone, level, size = spark._jvm.org.apache.hadoop.fs, 0, 0, 1
    while size * FAN <= batches:
        for place in range(batches // (size * FAN) * FAN):
            path = files.Path(_path(folder, (level, place)))
            gone += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        level, size = level + 1, size * FAN
    return gone


def raised_layers(edges: DataFrame, layers: DataFrame, new_edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(v, layer) of the vertices that more edges bring or raise, and of no others: only vertices behind a raised one are looked at, until nothing rises.

    edges hold the new ones already. Raises RuntimeError when layers still rise after max_rounds, as on a cycle.
    """
    ends = new_edges.select(F.explode(F.array("src", "dst")).alias("v")).distinct()
    found = written(ends.join(layers, "v", "left").select("v", F.coalesce("layer", F.lit(0)).alias("layer"), F.col("layer").isNull().alias("new")), "ends")
    changes = found.where("new").select("v", "layer")
    dirty = new_edges.select(F.col("src").alias("v")).distinct().join(found.select("v", "layer"), "v")
    for k in range(max_rounds):
        pushed = edges.join(dirty.withColumnRenamed("v", "src"), "src").groupBy(F.col("dst").alias("v")).agg((F.max("layer") + 1).alias("least"))
        known = changes.groupBy("v").agg(F.max("layer").alias("_up"))
        at = pushed.join(layers, "v", "left").join(known, "v", "left")
        dirty = written(at.where(F.col("least") > F.greatest(F.coalesce("layer", F.lit(0)), F.coalesce("_up", F.lit(0)))).select("v", F.col("least").alias("layer")), "dirty")
        if dirty.isEmpty():
            return changes.groupBy("v").agg(F.max("layer").alias("layer"))
        changes = changes.unionByName(dirty)
        if k % 8 == 7:  # what rose is read from its own files, and joined into one table now and then
            changes = written(changes.groupBy("v").agg(F.max("layer").alias("layer")), "changes")
    raise RuntimeError(f"layers still rise after {max_rounds} rounds; is there a cycle?")


def relaxed_layers(edges: DataFrame, layers: DataFrame, new_edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(v, layer) of all vertices after more edges."""
    return _highest(layers.select("v", "layer").unionByName(raised_layers(edges, layers, new_edges, max_rounds)))


def _highest(log: DataFrame) -> DataFrame:
    """Layers only rise, so the highest of a vertex is its last."""
    return log.groupBy("v").agg(F.max("layer").alias("layer"))


EDGE, LAYER = "src string, dst string", "v string, layer int"


def stored_layers(spark: SparkSession, store: str, batches: int) -> DataFrame:
    """(v, layer) after so many batches of layer_stream."""
    return _highest(log_rows(spark, f"{store}/layers", LAYER, batches))


def layer_stream(spark: SparkSession, source: str, store: str, checkpoint: str, max_rounds: int = 100) -> StreamingQuery:
    """Edge files (Parquet: src, dst) under source; each batch appends its new edges to the log store/edges and the layers that it brings or raises to store/layers.

    `stored_layers` reads the layers. Loops, repeats and edges with a null end are left out.
    """
    stream = spark.readStream.schema(EDGE).parquet(source)

    def step(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        fresh = batch.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct()
        new = written(fresh.join(log_rows(session, f"{store}/edges", EDGE, number), ["src", "dst"], "left_anti"), "new")
        append_segment(new, f"{store}/edges", EDGE, number)
        edges = log_rows(session, f"{store}/edges", EDGE, number + 1)
        append_segment(raised_layers(edges, stored_layers(session, store, number), new, max_rounds), f"{store}/layers", LAYER, number, _highest)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


ARTICLE = "uid string, title string, cites array<struct<uid:string,title:string>>"
VERSION = "uid string, title string, loaded boolean, batch long"
LINK = "src string, dst string"


def _latest(log: DataFrame) -> DataFrame:
    """Of each uid the last loaded row; where there is none, the stub of its first batch that names a title, else its first."""
    blank = F.coalesce(F.trim("title"), F.lit("")) == ""
    order = F.struct("loaded", F.when(F.col("loaded"), F.lit(0)).when(blank, F.lit(0)).otherwise(1).alias("named"), F.when(F.col("loaded"), F.col("batch")).otherwise(-F.col("batch")).alias("age"), F.coalesce("title", F.lit("")).alias("tie"))
    return log.groupBy("uid").agg(F.max_by(F.struct("title", "loaded", "batch"), order).alias("m")).select("uid", "m.*")


def stored_articles(spark: SparkSession, store: str, batches: int) -> DataFrame:
    """(uid, title, layout_status) after so many batches of article_stream: loaded articles are unprocessed, ends of links that no file holds are stubs, named by the first link that has a title for them."""
    rows = _latest(log_rows(spark, f"{store}/articles", VERSION, batches))
    return rows.select("uid", "title", F.when(F.col("loaded"), "unprocessed").otherwise("stub").alias("layout_status"))


def stored_links(spark: SparkSession, store: str, batches: int) -> DataFrame:
    """(src, dst) from cited to citing after so many batches of article_stream."""
    return log_rows(spark, f"{store}/links", LINK, batches)


def article_stream(spark: SparkSession, source: str, store: str, checkpoint: str) -> StreamingQuery:
    """Article files (Parquet: uid, title and, if any, cites with uid and title) under source; each batch appends its articles, its stubs and its new links to logs.

    An article replaces an earlier one of equal uid, or a stub; of equal uids in a batch the largest
    title stays. Self citations, repeated links and null ids are left out.
    """
    stream = spark.readStream.schema(ARTICLE).parquet(source)

    def step(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        rows = written(batch.where("uid IS NOT NULL"), "batch")
        cited = rows.select("uid", F.explode("cites").alias("c")).where("c.uid IS NOT NULL AND c.uid <> uid").select(F.col("c.uid").alias("src"), F.col("uid").alias("dst"), "c.title")
        loaded = rows.groupBy("uid").agg(F.max("title").alias("title")).withColumn("loaded", F.lit(True))
        stubs = cited.groupBy(F.col("src").alias("uid")).agg(F.min(F.when(F.trim("title") != "", F.col("title"))).alias("title")).withColumn("loaded", F.lit(False))
        append_segment(loaded.unionByName(stubs).withColumn("batch", F.lit(number).cast("long")), f"{store}/articles", VERSION, number, _latest)
        new = cited.select("src", "dst").distinct().join(stored_links(session, store, number), ["src", "dst"], "left_anti")
        append_segment(new, f"{store}/links", LINK, number)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
