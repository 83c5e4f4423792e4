"""Article XML and archives made from documents by rule, read back through the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkgraph.operators import profile
from inkgraph.plans import adapters as ad
from inkgraph.plans.adapters import ARTICLES
from inkgraph.sources import archives, articles, xml_paths

UNCLEAN = r"[^\p{L}\p{N} .,]"


def article_members(spark, d):
    """(name, xml): an article for each document; every 13th lacks its end, every 17th has another root, every 11th is no .xml member."""
    k, s = F.col("doc_id"), lambda x: F.lit(x)
    clean = F.regexp_replace(F.coalesce("text", F.lit("")), UNCLEAN, " ")
    refs = F.concat(*(F.concat(s(f'<ref id="r{n}"><element-citation><pub-id pub-id-type="pmid">'), F.floor(k / n).cast("string"), s("</pub-id></element-citation></ref>")) for n in (2, 3)), s('<ref id="r4"/>'))
    xml = F.concat(
        s('<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE article>\n<article article-type="'), F.col("lang"), s('" id="a"><front><journal-meta><journal-title-group><journal-title>'), F.col("source"), s("</journal-title></journal-title-group></journal-meta><article-meta>"),
        s('<article-id pub-id-type="pmid">'), k.cast("string"), s('</article-id><title-group><article-title>'), F.substring(clean, 1, 60), s("</article-title></title-group><pub-date><year>"), (1990 + k % 30).cast("string"), s('</year></pub-date><kwd-group kwd-group-type="'), F.col("source"), s('"><kwd id="k1">'), F.col("lang"), s("</kwd></kwd-group></article-meta></front>"),
        s('<body><sec id="s1"><p>'), clean, s('&nbsp;<xref rid="F1"/> <xref rid="T1"></xref> <xref rid="F1"/></p><inline-formula><math><mi>x</mi></math></inline-formula></sec></body><back><ref-list>'), refs,
        s('</ref-list></back><floats-group><fig id="F1"><p>figure <xref rid="T1"/></p></fig><table-wrap id="T1"><p>table</p></table-wrap></floats-group></article>'),
    )
    broken = F.when(k % 13 == 0, F.substring(xml, F.lit(1), F.length(xml) - 10)).when(k % 17 == 0, F.concat(s("<note>"), k.cast("string"), s("</note>"))).otherwise(xml)
    return ad.table(spark, d, "documents").select(F.concat(s("d"), k.cast("string"), F.when(k % 11 == 0, ".txt").otherwise(".xml")).alias("name"), broken.alias("xml"))


def _members(spark, d):
    return archives.read_members(archives.pack_archives(article_members(spark, d)))


def _good(spark, d):
    return _members(spark, d).where("error IS NULL").select(F.col("member").alias("path"), "xml", "body")


def _fields(spark, d):
    return articles.article_fields(_good(spark, d)).select("uid", "pmid", "title", "journal", "year", F.array_join("keywords", ",").alias("keywords"), F.length("body").cast("long").alias("body_chars"), F.md5("body").alias("body_md5"))


QUERIES = {
    "archive_articles": _fields,
    "archive_rejected": lambda s, d: _members(s, d).where("error IS NOT NULL").select("member", "error"),
    "archive_references": lambda s, d: articles.references(articles.article_fields(_good(s, d))).select("citing", "pos", "pmid"),
    "archive_citation_edges": lambda s, d: articles.citation_edges(articles.references(articles.article_fields(_good(s, d)))),
    "archive_path_counts": lambda s, d: xml_paths.path_counts(_good(s, d)),
    "archive_paths_merged": lambda s, d: xml_paths.merged(xml_paths.path_counts(_good(s, d)), xml_paths.from_lines(xml_paths.as_lines(xml_paths.path_counts(_good(s, d))))),
    "ingest_rejected": lambda s, d: profile.validate_mandatory(ad.articles(s, d), ["title", "doi", "abstract"])[1].select("uid", "reason"),
    "ingest_accepted": lambda s, d: profile.validate_mandatory(ad.articles(s, d), ["title", "doi", "abstract"])[0].select("uid", "title", "doi"),
}

_C = f"""c AS (SELECT *, regexp_replace(coalesce(text, ''), '{UNCLEAN}', ' ', 'g') AS clean FROM documents WHERE doc_id % 11 <> 0), g AS (SELECT * FROM c WHERE doc_id % 13 <> 0 AND doc_id % 17 <> 0),
    b AS (SELECT *, '<table-wrap id="T1"><p>table</p></table-wrap>' AS t, '<fig id="F1"><p>figure ' || t || '</p></fig>' AS f, '<body><sec id="s1"><p>' || clean || chr(160) || f || ' ' || t || ' ' || f || '</p><inline-formula><math><mi>x</mi></math></inline-formula></sec></body>' AS body FROM g)"""
_PATHS = """p AS (
    SELECT unnest(['front', 'front → journal-meta', 'front → journal-meta → journal-title-group', 'front → journal-meta → journal-title-group → journal-title', 'front → article-meta', 'front → article-meta → article-id',
        'front → article-meta → article-id → @pub-id-type=pmid', 'front → article-meta → title-group', 'front → article-meta → title-group → article-title', 'front → article-meta → pub-date', 'front → article-meta → pub-date → year',
        'front → article-meta → kwd-group', 'front → article-meta → kwd-group → @kwd-group-type=' || source, 'front → article-meta → kwd-group → kwd', 'front → article-meta → kwd-group → kwd → @id', 'article → @article-type=' || lang, 'article → @id',
        'body', 'body → sec', 'body → sec → @id', 'body → sec → p', 'body → sec → p → xref', 'body → sec → p → xref', 'body → sec → p → xref', 'body → sec → p → xref → @rid', 'body → sec → p → xref → @rid', 'body → sec → p → xref → @rid',
        'back', 'back → ref-list', 'back → ref-list → ref', 'back → ref-list → ref', 'back → ref-list → ref', 'back → ref-list → ref → @id', 'back → ref-list → ref → @id', 'back → ref-list → ref → @id', 'back → ref-list → ref → element-citation', 'back → ref-list → ref → element-citation',
        'back → ref-list → ref → element-citation → pub-id', 'back → ref-list → ref → element-citation → pub-id', 'back → ref-list → ref → element-citation → pub-id → @pub-id-type=pmid', 'back → ref-list → ref → element-citation → pub-id → @pub-id-type=pmid',
        'floats-group', 'floats-group → fig', 'floats-group → fig → @id', 'floats-group → fig → p', 'floats-group → fig → p → xref', 'floats-group → fig → p → xref → @rid', 'floats-group → table-wrap', 'floats-group → table-wrap → @id', 'floats-group → table-wrap → p']) AS path FROM g)"""

ORACLE_SQL = {
    "archive_articles": f"WITH {_C} SELECT CAST(doc_id AS VARCHAR) AS uid, CAST(doc_id AS VARCHAR) AS pmid, nullif(trim(substr(clean, 1, 60)), '') AS title, source AS journal, CAST(1990 + doc_id % 30 AS VARCHAR) AS year, lang AS keywords, length(body) AS body_chars, md5(body) AS body_md5 FROM b",
    "archive_rejected": "SELECT 'd' || doc_id || '.xml' AS member, CASE WHEN doc_id % 13 = 0 THEN 'not well formed' ELSE 'root is note' END AS error FROM documents WHERE doc_id % 11 <> 0 AND (doc_id % 13 = 0 OR doc_id % 17 = 0)",
    "archive_references": f"WITH {_C}, r AS (SELECT doc_id, 0 AS pos, doc_id // 2 AS q FROM g UNION ALL SELECT doc_id, 1, doc_id // 3 FROM g) SELECT CAST(doc_id AS VARCHAR) AS citing, CAST(min(pos) AS INTEGER) AS pos, CAST(q AS VARCHAR) AS pmid FROM r GROUP BY doc_id, q",
    "archive_citation_edges": f"WITH {_C}, r AS (SELECT doc_id, doc_id // 2 AS q FROM g UNION SELECT doc_id, doc_id // 3 FROM g) SELECT CAST(q AS VARCHAR) AS src, CAST(doc_id AS VARCHAR) AS dst FROM r WHERE q <> doc_id",
    "archive_path_counts": f"WITH {_C}, {_PATHS} SELECT path, count(*) AS n FROM p GROUP BY path",
    "archive_paths_merged": f"WITH {_C}, {_PATHS} SELECT path, 2 * count(*) AS n FROM p GROUP BY path",
    "ingest_rejected": f"WITH {ARTICLES}, t AS (SELECT uid, concat_ws(', ', CASE WHEN coalesce(trim(title), '') = '' THEN 'title' END, CASE WHEN coalesce(trim(doi), '') = '' THEN 'doi' END, CASE WHEN coalesce(trim(abstract), '') = '' THEN 'abstract' END) AS m FROM a) SELECT uid, 'missing: ' || m AS reason FROM t WHERE m <> ''",
    "ingest_accepted": f"WITH {ARTICLES} SELECT uid, title, doi FROM a WHERE coalesce(trim(title), '') <> '' AND coalesce(trim(doi), '') <> '' AND coalesce(trim(abstract), '') <> ''",
}
