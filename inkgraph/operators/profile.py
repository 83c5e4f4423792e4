"""Corpus profiles over articles (uid, title, journal, year, doi, abstract, authors, keywords) and links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def totals(articles: DataFrame, links: DataFrame) -> DataFrame:
    """One row: articles and links."""
    return articles.agg(F.count("*").alias("articles")).crossJoin(links.agg(F.count("*").alias("links")))


def top_values(df: DataFrame, column: str, most: int = 10) -> DataFrame:
    """The most frequent values of a column, null left out, ties by value."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(most)


def latest_years(articles: DataFrame, most: int = 10) -> DataFrame:
    return articles.where("year IS NOT NULL").groupBy("year").agg(F.count("*").alias("n")).orderBy(F.desc("year")).limit(most)


def size_histogram(articles: DataFrame, column: str, most: int = 5) -> DataFrame:
    """(size, n) of an array column, the largest sizes first."""
    return articles.groupBy(F.coalesce(F.size(column), F.lit(0)).alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("size")).limit(most)


def link_totals(links: DataFrame) -> DataFrame:
    """One row: outgoing and incoming links, distinct targets."""
    return links.agg(F.count("src").alias("outgoing"), F.count("dst").alias("incoming"), F.countDistinct("dst").alias("targets"))


def stubs(articles: DataFrame) -> DataFrame:
    """Articles known by their id alone."""
    return articles.where((F.coalesce(F.trim("title"), F.lit("")) == "") & F.col("journal").isNull() & F.col("abstract").isNull() & (F.coalesce(F.size("authors"), F.lit(0)) == 0)).select("uid")


def top_degree(articles: DataFrame, links: DataFrame, end: str, most: int = 5) -> DataFrame:
    """The articles with the most links at an end, with title and journal; the join comes after the cut."""
    top = links.where(F.col(end).isNotNull()).groupBy(F.col(end).alias("uid")).agg(F.count("*").alias("links")).orderBy(F.desc("links"), "uid").limit(most)
    return top.join(articles.select("uid", "title", "journal"), "uid")


def coverage(articles: DataFrame) -> DataFrame:
    """(field, n, percent) of articles that have a doi, an abstract, keywords."""
    has = {"doi": F.col("doi").isNotNull(), "abstract": F.col("abstract").isNotNull(), "keywords": F.size("keywords") > 0}
    one = articles.agg(F.count("*").alias("total"), *(F.count(F.when(c, 1)).alias(k) for k, c in has.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("field"), F.col(k).alias("n"), F.round(100.0 * F.col(k) / F.col("total"), 4).alias("percent")) for k in has))).alias("x")).select("x.*")


def bad_ids(articles: DataFrame) -> DataFrame:
    return articles.agg(F.count(F.when(F.coalesce(F.trim("uid"), F.lit("")) == "", 1)).alias("bad"), F.count("*").alias("total"))


def edge_sample(edges: DataFrame, most: int = 10) -> DataFrame:
    """(relation, src, dst): of each type of edge the first `most` by (src, dst), repeats once; a null type is one of them."""
    order = W.partitionBy("relation").orderBy("src", "dst")
    rows = edges.select("relation", "src", "dst").distinct().withColumn("_r", F.row_number().over(order))
    return rows.where(F.col("_r") <= most).drop("_r")


def distribution(df: DataFrame, column: str) -> DataFrame:
    """(value, n, percent) of a column."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).select("value", "n", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("percent"))


def compare_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """(metric, before, after, change_percent) of two tables (metric, value); null where there is no base."""
    joined = before.toDF("metric", "before").join(after.toDF("metric", "after"), "metric", "full")
    return joined.withColumn("change_percent", F.when(F.col("before") != 0, F.round(100.0 * (F.col("after") - F.col("before")) / F.col("before"), 4)))


def missing_reasons(df: DataFrame, required: list[str]) -> DataFrame:
    """(reason, n): rows by the mandatory fields that they lack; an empty reason for complete rows."""
    lacking = F.concat_ws(", ", *(F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", F.lit(c)) for c in required))
    return df.groupBy(F.when(lacking != "", F.concat(F.lit("missing: "), lacking)).otherwise("").alias("reason")).agg(F.count("*").alias("n"))


def validate_mandatory(df: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): rows that have all mandatory fields, and the others with the reason `missing: a, b`."""
    lacking = F.concat_ws(", ", *(F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", F.lit(c)) for c in required))
    return df.where(lacking == ""), df.where(lacking != "").withColumn("reason", F.concat(F.lit("missing: "), lacking))


def upsert_articles(target: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of the batch replace those of equal uid and are unprocessed; others stay as they are."""
    kept = target.join(batch.select("uid"), "uid", "left_anti")
    one = batch.withColumn("_r", F.row_number().over(W.partitionBy("uid").orderBy(F.to_json(F.struct("*")).desc()))).where("_r = 1").drop("_r")
    return kept.unionByName(one.withColumn("layout_status", F.lit("unprocessed")), allowMissingColumns=True)


def upsert_edges(articles: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stub vertices to add, edges to keep): unknown ends become stubs, loops and repeats go."""
    clean = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select("src", "dst").distinct()
    ends = clean.select(F.explode(F.array("src", "dst")).alias("uid")).distinct()
    return ends.join(articles.select("uid"), "uid", "left_anti"), clean


def stub_titles(articles: DataFrame, edges: DataFrame) -> DataFrame:
    """Articles whose blank title is filled from the edges (src, dst, src_title, dst_title) that name them: the smallest title that isn't blank; other titles stay."""
    named = edges.select(F.explode(F.array(F.struct(F.col("src").alias("uid"), F.col("src_title").alias("t")), F.struct(F.col("dst").alias("uid"), F.col("dst_title").alias("t")))).alias("e")).select("e.*")
    titles = named.where("uid IS NOT NULL AND trim(t) <> ''").groupBy("uid").agg(F.min("t").alias("_title"))
    blank = F.coalesce(F.trim("title"), F.lit("")) == ""
    return articles.join(titles, "uid", "left").withColumn("title", F.when(blank, F.coalesce("_title", "title")).otherwise(F.col("title"))).select(*articles.columns)


def resume(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files that are not loaded yet."""
    return files.join(done.select("file"), "file", "left_anti")
