"""Syntax over rule dependencies, merged votes, change tables and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkgraph.operators import chains, syntax, text_votes, tokens, voting
from inkgraph.operators.cutting import tagged_texts
from inkgraph.plans.adapters import SD, SW, sentence_deps, sentence_words, table
from inkgraph.plans.text_queries import RATINGS, WORDS, _docs, _ratings, _words


SDEPS = f"{SW}, {SD}, dp AS (SELECT * FROM sd)"


def _pairs_of_raters(s, d):
    """(kind, agreed, total) of each two raters, in the places of tokens, dependencies and entities."""
    r = _ratings(s, d)
    frames = None
    for kind, a, b in (("tokens", "quality", "civil"), ("dependencies", "quality", "long"), ("entities", "civil", "long")):
        x, y = r.where(F.col("rater") == a).select("item", F.col("category").alias("x")), r.where(F.col("rater") == b).select("item", F.col("category").alias("y"))
        part = x.join(y, "item").agg(F.count(F.when(F.col("x") == F.col("y"), 1)).alias("agreed"), F.count("*").alias("total")).withColumn("kind", F.lit(kind))
        frames = part if frames is None else frames.unionByName(part)
    return frames


QUERIES = {
    "syntax_roots": lambda s, d: syntax.roots(sentence_deps(s, d)).groupBy("doc_id").agg(F.count("*").alias("n")),
    "syntax_dependents": lambda s, d: syntax.dependents(sentence_deps(s, d)).groupBy("doc_id").agg(F.count("*").alias("heads"), F.sum(F.size("dependents")).alias("dependents")),
    "syntax_svo": lambda s, d: syntax.subject_verb_object(sentence_words(s, d), sentence_deps(s, d)),
    "syntax_patterns": lambda s, d: syntax.sentences_with(sentence_deps(s, d), ["nsubj", "obj", "conj"]),
    "syntax_verb_phrases": lambda s, d: syntax.verb_phrases(sentence_words(s, d), sentence_deps(s, d)),
    "syntax_relations": lambda s, d: syntax.relation_distribution(sentence_deps(s, d)),
    "chains_direct_links": lambda s, d: syntax.direct_verb_links(sentence_words(s, d), sentence_deps(s, d)).groupBy("doc_id").agg(F.count("*").alias("n")),
    "tokens_morph": lambda s, d: _words(s, d).groupBy(tokens.guessed_morph(F.col("text"), F.col("pos")).alias("morph")).agg(F.count("*").alias("n")),
    "tokens_with_feature": lambda s, d: tokens.with_feature(tagged_texts(_docs(s, d), "word").withColumn("morph", tokens.parsed_morph(tokens.guessed_morph(F.col("text"), F.col("pos")))), "Tense", "Past").groupBy("doc_id").agg(F.count("*").alias("n")),
    "tokens_types": lambda s, d: tokens.types_by_category(_words(s, d)),
    "vote_merge_tokens": lambda s, d: text_votes.merge_texts(_docs(s, d)).groupBy("sources", "pos").agg(F.count("*").alias("n")),
    "vote_entities": lambda s, d: voting.vote_entities(tokens.tagged(tokens.tokenize(_docs(s, d))).where("length(text) > 8").withColumnRenamed("pos", "entity_type")).groupBy("entity_type", "votes").agg(F.count("*").alias("n")),
    "vote_overall": lambda s, d: voting.overall_agreement(_pairs_of_raters(s, d)),
    "chains_upsert": lambda s, d: chains.upsert_sequences(table(s, d, "lineitem").where("l_linenumber <= 2").select(F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b"), F.col("l_discount").alias("confidence")), table(s, d, "lineitem").where("l_linenumber >= 2 AND l_linenumber <= 3").select(F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b"), F.col("l_tax").alias("confidence"))),
}

ORACLE_SQL = {
    "vote_overall": f"WITH {RATINGS}, p AS (SELECT x.rater || '-' || y.rater AS k, avg(CASE WHEN x.category = y.category THEN 1.0 ELSE 0.0 END) AS a FROM r x JOIN r y USING (item) WHERE (x.rater, y.rater) IN (('quality','civil'), ('quality','long'), ('civil','long')) GROUP BY 1) SELECT round(sum(a * CASE k WHEN 'quality-civil' THEN 1 WHEN 'quality-long' THEN 2 ELSE 1.5 END) / 4.5, 6)::DOUBLE AS agreement FROM p",
    "tokens_morph": f"WITH {WORDS} SELECT CASE WHEN pos = 'VERB' AND lower(text) LIKE '%ing' THEN 'Tense=Pres|VerbForm=Part' WHEN pos = 'VERB' AND lower(text) LIKE '%ed' THEN 'Tense=Past|VerbForm=Fin' WHEN pos = 'NOUN' AND lower(text) LIKE '%s' THEN 'Number=Plur' WHEN pos = 'NOUN' THEN 'Number=Sing' WHEN pos = 'ADJ' AND lower(text) LIKE '%est' THEN 'Degree=Sup' END AS morph, count(*) AS n FROM t GROUP BY 1",
    "tokens_with_feature": f"WITH {WORDS} SELECT doc_id, count(*) AS n FROM t WHERE tag = 'VBD' GROUP BY 1",
    "tokens_types": f"WITH {WORDS}, c AS (SELECT DISTINCT CASE WHEN pos IN ('ADJ','ADV','NOUN','VERB') THEN 'open' WHEN pos IN ('ADP','CCONJ','DET','NUM') THEN 'closed' ELSE 'other' END AS category, tag FROM t) SELECT category, string_agg(tag, ',' ORDER BY tag) AS types FROM c GROUP BY 1",
    "syntax_roots": f"WITH {SDEPS} SELECT doc_id, count(*) AS n FROM dp WHERE relation = 'root' GROUP BY 1",
    "syntax_dependents": f"WITH {SDEPS} SELECT doc_id, count(DISTINCT (sent_idx, head)) AS heads, count(DISTINCT (sent_idx, head, dependent)) AS dependents FROM dp WHERE relation <> 'root' GROUP BY 1",
    "syntax_svo": f"WITH {SDEPS}, v AS (SELECT doc_id, sent_idx, dependent AS i, text AS verb FROM dp WHERE relation = 'root') SELECT doc_id, sent_idx, verb, (SELECT arg_max(text, dependent) FROM dp WHERE dp.doc_id = v.doc_id AND dp.sent_idx = v.sent_idx AND relation = 'nsubj') AS subject, (SELECT arg_max(text, dependent) FROM dp WHERE dp.doc_id = v.doc_id AND dp.sent_idx = v.sent_idx AND relation = 'obj') AS object FROM v",
    "syntax_patterns": f"WITH {SDEPS} SELECT doc_id, sent_idx, count(*) AS pairs FROM dp WHERE relation IN ('nsubj','obj','conj') GROUP BY 1, 2 HAVING count(DISTINCT relation) = 3",
    "syntax_verb_phrases": f"WITH {SDEPS} SELECT doc_id, sent_idx, verb, CAST(min(i) AS INTEGER) AS start, CAST(max(i) + 1 AS INTEGER) AS \"end\" FROM (SELECT doc_id, sent_idx, token_idx AS verb, token_idx AS i FROM sw WHERE pos = 'VERB' UNION ALL SELECT doc_id, sent_idx, head, dependent FROM dp WHERE relation = 'aux') GROUP BY 1, 2, 3",
    "syntax_relations": f"WITH {SDEPS} SELECT relation, count(*) AS n FROM dp GROUP BY 1 ORDER BY n DESC, relation LIMIT 15",
    "chains_direct_links": f"WITH {SDEPS} SELECT doc_id, count(DISTINCT (sent_idx, least(head, dependent), greatest(head, dependent))) AS n FROM dp WHERE relation IN ('conj','xcomp','advcl') GROUP BY 1",
    "chains_upsert": "WITH o AS (SELECT l_orderkey AS a, l_linenumber AS b, l_discount AS o FROM lineitem WHERE l_linenumber <= 2), w AS (SELECT l_orderkey AS a, l_linenumber AS b, l_tax AS n FROM lineitem WHERE l_linenumber BETWEEN 2 AND 3) SELECT a, b, coalesce(n, o) AS confidence, CASE WHEN o IS NULL THEN 'created' WHEN n IS NOT NULL THEN 'updated' ELSE 'kept' END AS change FROM o FULL JOIN w USING (a, b)",
}
