"""Dictionary hits, entity cascades down to keywords, and the best paths of the citation graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkgraph.operators import actions, dictionary, graph, paths
from inkgraph.operators.vocabulary import KEYWORDS
from inkgraph.plans import adapters as ad
from inkgraph.plans.adapters import CLEAN, SW
from inkgraph.plans.scratch import written


def _terms(spark):
    return spark.createDataFrame([(k,) for k in KEYWORDS], "term string")


def _openings(s, d):
    """The first two words of each benchmark item: a dictionary that comes from a table."""
    return ad.table(s, d, "benchmark").select(F.substring_index("text", " ", 2).alias("term"))


def _cascade(s, d):
    """Long words, words of ten letters, keywords as fourth, words of nine letters as seventh stage, and numbers without priority."""
    w = ad.sentence_words(s, d)
    stage = F.when(F.length("text") >= 12, 1).when(F.length("text") == 10, 2).when(F.length("text") == 9, 7)
    words = w.where("length(text) >= 12 OR length(text) IN (9, 10) OR tag = 'CD'").select("doc_id", "start", "end", stage.alias("priority"))
    keywords = dictionary.keyword_entities(ad.table(s, d, "documents"), _terms(s)).select("doc_id", F.col("start").cast(w.schema["start"].dataType).alias("start"), F.col("end").cast(w.schema["end"].dataType).alias("end"), "priority")
    return actions.without_overlaps(written(words.unionByName(keywords).distinct(), "entities"))


def _weighted(s, d):
    return graph.clean_edges(ad.citations(s, d)).withColumn("confidence", (F.length(F.concat("src", "dst")) % 7 + 1) / 10)


QUERIES = {
    "dictionary_keywords": lambda s, d: dictionary.dictionary_hits(ad.table(s, d, "documents"), _terms(s)),
    "dictionary_of_table": lambda s, d: dictionary.dictionary_hits(ad.table(s, d, "documents"), _openings(s, d)).groupBy("term").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"), F.min("start").alias("first_start")),
    "actions_entity_cascade_keywords": _cascade,
    "graph_best_paths": lambda s, d: paths.best_paths(_weighted(s, d)).select(F.array_join("path", ">").alias("path"), "length", "confidence", "rank"),
    "graph_best_open_paths": lambda s, d: paths.best_paths(_weighted(s, d), 20, maximal=False).select(F.array_join("path", ">").alias("path"), "length", "confidence", "rank"),
}

_KEYS = ", ".join(f"('{k}')" for k in KEYWORDS)
_HITS = """p AS (SELECT doc_id, text, term, length(term) AS n, string_split(lower(text), lower(term)) AS s FROM documents CROSS JOIN k WHERE contains(lower(text), lower(term))),
    g AS (SELECT doc_id, text, term, n, unnest(s) AS piece, generate_subscripts(s, 1) AS i, len(s) AS parts FROM p),
    h AS (SELECT doc_id, text, term, n, i, parts, CAST(sum(length(piece) + n) OVER (PARTITION BY doc_id, term ORDER BY i) AS BIGINT) AS "end" FROM g),
    hits AS (SELECT doc_id, term, "end" - n AS start, "end", substr(text, "end" - n + 1, n) AS text FROM h WHERE i < parts)"""
_BEST = f"""{CLEAN}, w AS (SELECT src, dst, (length(src || dst) % 7 + 1) * 100000 AS c FROM k),
    r AS (SELECT DISTINCT [src] AS path, 0 AS length, 0 AS sum FROM w WHERE src NOT IN (SELECT dst FROM w) UNION ALL SELECT list_append(path, dst), length + 1, sum + c FROM r JOIN w ON w.src = path[-1]),
    o AS (SELECT *, row_number() OVER (ORDER BY length DESC, sum DESC, path) AS rank FROM r WHERE length >= 2 AND {{}})
    SELECT array_to_string(path, '>') AS path, CAST(length AS INTEGER) AS length, round(sum / length / 1000000.0::DOUBLE, 6) AS confidence, CAST(rank AS INTEGER) AS rank FROM o WHERE rank <= {{}}"""

ORACLE_SQL = {
    "dictionary_keywords": f"WITH k(term) AS (VALUES {_KEYS}), {_HITS} SELECT * FROM hits",
    "dictionary_of_table": f"WITH k AS (SELECT DISTINCT CASE WHEN len(string_split(text, ' ')) > 2 THEN array_to_string(string_split(text, ' ')[1:2], ' ') ELSE text END AS term FROM benchmark), {_HITS} SELECT term, count(*) AS n, count(DISTINCT doc_id) AS documents, min(start) AS first_start FROM hits GROUP BY term",
    "actions_entity_cascade_keywords": f"""WITH {SW}, k(term) AS (VALUES {_KEYS}), {_HITS}, k1 AS (SELECT doc_id, start, "end", CAST(1 AS INTEGER) AS priority FROM sw WHERE length(text) >= 12),
        o2 AS (SELECT doc_id, start, "end" FROM sw WHERE length(text) = 10), k2 AS (FROM k1 UNION ALL SELECT *, 2 FROM o2 x WHERE NOT EXISTS (SELECT 1 FROM k1 y WHERE y.doc_id = x.doc_id AND y.start < x."end" AND y."end" > x.start)),
        o4 AS (SELECT DISTINCT doc_id, start, "end" FROM hits), k4 AS (FROM k2 UNION ALL SELECT *, 4 FROM o4 x WHERE NOT EXISTS (SELECT 1 FROM k2 y WHERE y.doc_id = x.doc_id AND y.start < x."end" AND y."end" > x.start)),
        o7 AS (SELECT doc_id, start, "end" FROM sw WHERE length(text) = 9), k7 AS (FROM k4 UNION ALL SELECT *, 7 FROM o7 x WHERE NOT EXISTS (SELECT 1 FROM k4 y WHERE y.doc_id = x.doc_id AND y.start < x."end" AND y."end" > x.start)),
        o9 AS (SELECT doc_id, start, "end" FROM sw WHERE tag = 'CD' AND length(text) < 9), k9 AS (FROM k7 UNION ALL SELECT *, NULL FROM o9 x WHERE NOT EXISTS (SELECT 1 FROM k7 y WHERE y.doc_id = x.doc_id AND y.start < x."end" AND y."end" > x.start))
        SELECT * FROM k9""",
    "graph_best_paths": f"WITH RECURSIVE {_BEST.format('path[-1] NOT IN (SELECT src FROM w)', 50)}",
    "graph_best_open_paths": f"WITH RECURSIVE {_BEST.format('true', 20)}",
}
