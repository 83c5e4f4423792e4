"""Citation XML, the second article dialect: one PubmedArticle element a record, many records a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgraph.sources.articles import _text

# fixed values of the dialect: longest title, journal, abstract, doi, name and keyword; most authors and keywords; last year
TITLE, JOURNAL, ABSTRACT, DOI, NAME, KEYWORD = 1000, 500, 5000, 200, 200, 200
AUTHORS, KEYWORDS = 50, 30
LAST_YEAR = 2030


def read_citation_records(spark: SparkSession, path: str) -> DataFrame:
    """(xml): the records of plain or gzip files. Lines end at a record's end tag, so no task holds a whole file."""
    lines = spark.read.text(path, lineSep="</PubmedArticle>")
    record = F.regexp_extract("value", r"(?s)(<PubmedArticle(?:\s[^>]*)?>.*)", 1)
    return lines.select(record.alias("_record")).where("_record <> ''").select(F.concat("_record", F.lit("</PubmedArticle>")).alias("xml"))


def _shortened(value: Column, most: int) -> Column:
    return F.when(F.length(value) > most, F.concat(F.substring(value, 1, most), F.lit("..."))).otherwise(value)


def citation_fields(records: DataFrame) -> DataFrame:
    """(pmid, doi, title, year, journal, abstract, authors, keywords, xml) of the records with a pmid; a missing part is null, missing lists are empty.

    Of authors and keywords the first AUTHORS and KEYWORDS count, without those that are blank or too
    long; an author may lack either name. The year is the first of 19xx and 20xx
    in the date, if it is LAST_YEAR or before.
    """
    xml = F.col("xml")
    date = F.coalesce(_text(xml, "//Journal/JournalIssue/PubDate/Year"), _text(xml, "//Journal/JournalIssue/PubDate/MedlineDate"))
    year = F.nullif(F.regexp_extract(date, r"\b(?:19|20)\d{2}\b", 0), F.lit(""))
    people = F.slice(F.regexp_extract_all("xml", F.lit(r"(?s)(<Author(?:\s[^>]*)?>.*?</Author>)"), F.lit(1)), 1, AUTHORS)
    names = F.transform(people, lambda a: F.concat_ws(" ", _text(a, "/Author/ForeName"), _text(a, "/Author/LastName")))
    terms = F.transform(F.slice(F.xpath(xml, F.lit("//MeshHeadingList/MeshHeading/DescriptorName/text()")), 1, KEYWORDS), lambda k: F.trim(k))
    return records.select(
        _text(xml, "//PMID").alias("pmid"), F.substring(_text(xml, "//ArticleIdList/ArticleId[@IdType='doi']"), 1, DOI).alias("doi"),
        _shortened(_text(xml, "//ArticleTitle"), TITLE).alias("title"), F.when(year.cast("int") <= LAST_YEAR, year).alias("year"),
        _shortened(_text(xml, "//Journal/Title"), JOURNAL).alias("journal"), _shortened(_text(xml, "//Abstract/AbstractText"), ABSTRACT).alias("abstract"),
        F.filter(names, lambda a: F.length(a).between(1, NAME)).alias("authors"), F.filter(terms, lambda k: F.length(k).between(1, KEYWORD)).alias("keywords"), "xml",
    ).where("pmid IS NOT NULL")


def cited_records(fields: DataFrame) -> DataFrame:
    """(citing, cited, title): references with a numeric pmid, one for each pair, the first in the list."""
    parts = F.regexp_extract_all("xml", F.lit(r"(?s)(<Reference(?:\s[^>]*[^/>])?>.*?</Reference>)"), F.lit(1))
    rows = fields.select(F.col("pmid").alias("citing"), F.posexplode(parts).alias("pos", "ref"))
    ref = F.col("ref")
    found = rows.select("citing", "pos", _text(ref, "//ArticleId[@IdType='pubmed']").alias("cited"), _shortened(_text(ref, "//ArticleTitle"), TITLE).alias("title"))
    return found.where(F.col("cited").rlike(r"^\d+$")).groupBy("citing", "cited").agg(F.min_by("title", "pos").alias("title"))
