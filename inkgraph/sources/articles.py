"""Article XML: fields, authors, keywords, references and citation edges, read by XPath expressions; namespaced tags match by local name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_article_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, xml) of the article files in a folder, one row a file."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").cast("string").alias("xml"))


def _text(xml: Column, path: str) -> Column:
    value = F.trim(F.xpath_string(xml, F.lit(path)))
    return F.when(value != "", value)


def _bare(pmcid: Column) -> Column:
    """Ids meet without their PMC prefix, on either side of a citation."""
    return F.regexp_replace(pmcid, "^PMC", "")


def article_fields(files: DataFrame) -> DataFrame:
    """uid, pmid, pmcid, doi, title, journal, year, abstract, authors, keywords (200 characters at most), xml and body of rows with an article root.

    Files must be well formed (`archives.read_members` or `archives.checked` put others aside); body is there if they bring it.
    """
    xml = F.col("xml")
    meta = "/article/front/article-meta"
    pmid, pmcid = _text(xml, f"{meta}/article-id[@pub-id-type='pmid']"), _bare(_text(xml, f"{meta}/article-id[@pub-id-type='pmc' or @pub-id-type='pmcid']"))
    # each author by itself: one part of a name may be missing, and a collaboration has neither
    contribs = F.filter(F.regexp_extract_all("xml", F.lit(r"(?s)(<(?:\w+:)?contrib\s[^>]*>.*?</(?:\w+:)?contrib>)"), F.lit(1)), lambda c: c.rlike("^[^>]*contrib-type=[\"']author[\"']"))
    part = lambda c, tag: F.trim(F.regexp_replace(F.regexp_extract(c, rf"(?s)<(?:\w+:)?{tag}[^>]*>(.*?)</(?:\w+:)?{tag}>", 1), "<[^>]*>", ""))
    authors = F.filter(F.transform(contribs, lambda c: F.trim(F.concat_ws(" ", part(c, "given-names"), part(c, "surname")))), lambda a: a != "")
    keywords = F.filter(F.transform(F.xpath(xml, F.lit(f"{meta}//kwd/text()")), lambda k: F.trim(k)), lambda k: F.length(k).between(1, 200))
    return files.where(F.xpath_boolean(xml, F.lit("/article"))).select(
        F.coalesce(pmcid, pmid, F.concat(F.lit("temp_id_"), F.xxhash64("path").cast("string"))).alias("uid"),
        pmid.alias("pmid"), pmcid.alias("pmcid"), _text(xml, f"{meta}/article-id[@pub-id-type='doi']").alias("doi"), _text(xml, f"{meta}//article-title").alias("title"),
        _text(xml, "/article/front/journal-meta//journal-title").alias("journal"),
        F.nullif(F.regexp_extract(F.xpath_string(xml, F.lit(f"{meta}//pub-date/year")), r"\b((?:19|20)\d{2})\b", 1), F.lit("")).alias("year"),
        _text(xml, f"{meta}/abstract").alias("abstract"), authors.alias("authors"), keywords.alias("keywords"), "xml", *(["body"] if "body" in files.columns else []),
    )


def references(articles: DataFrame) -> DataFrame:
    """(citing, pos, pmid, pmcid, doi, url, title, year), one row for each distinct reference that has an id or a title.

    References are taken one by one by their position in the list, since parts of them may be missing.
    """
    # the XML of each reference is cut out by its tags, so that every path below sees one reference
    parts = F.regexp_extract_all("xml", F.lit(r"(?s)(<(?:\w+:)?ref(?:\s[^>]*[^/>])?>.*?</(?:\w+:)?ref>)"), F.lit(1))  # not <ref id="1"/>
    rows = articles.select(F.col("uid").alias("citing"), F.posexplode(parts).alias("pos", "ref"))
    ref = F.regexp_replace(F.regexp_replace("ref", r"xlink:href", "href"), r"(</?)\w+:", "$1")
    url = F.xpath_string(ref, F.lit("//ext-link/@href"))
    title = F.coalesce(_text(ref, "//article-title"), _text(ref, "//source"))
    found = rows.select(
        "citing", "pos", _text(ref, "//pub-id[@pub-id-type='pmid']").alias("pmid"), _bare(_text(ref, "//pub-id[@pub-id-type='pmcid' or @pub-id-type='pmc']")).alias("pmcid"),
        _text(ref, "//pub-id[@pub-id-type='doi']").alias("doi"), F.when(url.startswith("http"), url).alias("url"), title.alias("title"),
        F.nullif(F.regexp_extract(F.xpath_string(ref, F.lit("//year")), r"\b((?:19|20)\d{2})\b", 1), F.lit("")).alias("year"),
    )
    useful = found.where("pmid IS NOT NULL OR pmcid IS NOT NULL OR doi IS NOT NULL OR url IS NOT NULL OR title IS NOT NULL")
    keys = [F.coalesce(c, F.lit("")) for c in ("pmid", "pmcid", "doi", "url")] + [F.substring(F.coalesce("title", F.lit("")), 1, 50)]
    first = useful.groupBy("citing", *(k.alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.min(F.struct("pos", "pmid", "pmcid", "doi", "url", "title", "year")).alias("r"))
    return first.select("citing", "r.*")


def citation_edges(refs: DataFrame) -> DataFrame:
    """(src, dst) from cited to citing; a DOI or an address alone makes no vertex."""
    return refs.select(F.coalesce("pmcid", "pmid").alias("src"), F.col("citing").alias("dst")).where("src IS NOT NULL AND src <> dst").distinct()


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href): links of web pages as references."""
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("pos", "href"))


def tag_counts(pages: DataFrame) -> DataFrame:
    """(tag, n): opening tags over all pages, an inventory of their markup."""
    return pages.select(F.explode(F.regexp_extract_all("html", F.lit(r"<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1))).alias("tag")).groupBy(F.lower("tag").alias("tag")).agg(F.count("*").alias("n"))


def morpheme_dictionary(lines: DataFrame) -> DataFrame:
    """(word, morphemes, comment) of lines `word/m1/m2 | comment`; blank lines and those with # are left out."""
    line = F.trim("value")
    rows = lines.where((line != "") & ~line.startswith("#"))
    parts = F.split(F.trim(F.substring_index(line, "|", 1)), "/")
    comment = F.when(line.contains("|"), F.trim(F.substring_index(line, "|", -1)))
    return rows.select(parts[0].alias("word"), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))).alias("morphemes"), comment.alias("comment"))
