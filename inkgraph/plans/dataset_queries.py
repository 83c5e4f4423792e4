"""Markdown drafts made of the documents: filtered, annotated and split; their samples exported and imported."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from inkgraph.operators import annotations as an
from inkgraph.operators import syntax, text, tokens
from inkgraph.plans.adapters import POS, SW, TAGS, sentence_words, table
from inkgraph.plans.scratch import scratch, written
from inkgraph.plans.text_queries import ANN, _annotations
from inkgraph.sources import datasets


def _drafts(s, d):
    """Documents with front matter, a heading, tables with and without a separator, references and an open block, by rule."""
    k = F.col("doc_id")
    part = lambda n, words: F.when(k % n == 0, F.lit(words)).otherwise("")
    return table(s, d, "documents").select("doc_id", F.concat(
        part(3, "---\nkey: 1\n---\n"), F.when(k % 2 == 0, F.lit("# Title of ")).otherwise("##  Part. "), k.cast("string"), part(4, ". "), F.lit("\n| a | b |\n|---|:-:|\n| 1 | 2 |\n"), F.coalesce("text", F.lit("")),
        part(4, "\n| alone |\nbehind it"), part(5, "\n## references \n[1] x\n"), part(7, "\n---\nopen")).alias("text"))


DRAFTS = """dr AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '---' || chr(10) || 'key: 1' || chr(10) || '---' || chr(10) ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN '# Title of ' ELSE '##  Part. ' END || doc_id || CASE WHEN doc_id % 4 = 0 THEN '. ' ELSE '' END
    || chr(10) || '| a | b |' || chr(10) || '|---|:-:|' || chr(10) || '| 1 | 2 |' || chr(10) || coalesce(text, '') || CASE WHEN doc_id % 4 = 0 THEN chr(10) || '| alone |' || chr(10) || 'behind it' ELSE '' END
    || CASE WHEN doc_id % 5 = 0 THEN chr(10) || '## references ' || chr(10) || '[1] x' || chr(10) ELSE '' END || CASE WHEN doc_id % 7 = 0 THEN chr(10) || '---' || chr(10) || 'open' ELSE '' END AS text FROM documents)"""
#: What the blueprint says of each line of a draft: blocks, references and table rows go; a heading loses its marks and ends with a period.
PIECES = DRAFTS + """, ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, len(string_split(text, chr(10))) AS lines FROM dr),
    la AS (SELECT *, CAST(sum(length(s) + 1) OVER o AS BIGINT) - length(s) - 1 AS a, count(*) FILTER (s = '---') OVER o AS f, lead(s) OVER (PARTITION BY doc_id ORDER BY line) AS nx FROM ln WINDOW o AS (PARTITION BY doc_id ORDER BY line)),
    lo AS (SELECT *, count(*) FILTER (lower(trim(s)) = '## references') OVER (PARTITION BY doc_id ORDER BY line) AS tail FROM la WHERE s <> '---' AND f % 2 = 0),
    lk AS (SELECT *, CASE WHEN line + 1 < lines THEN chr(10) ELSE '' END AS nl, starts_with(s, '#') AS h, trim(ltrim(s, '#')) AS t, length(s) - length(ltrim(s, '# ')) AS pre FROM lo WHERE tail = 0 AND s NOT IN ('| a | b |', '|---|:-:|', '| 1 | 2 |')),
    pc AS (SELECT doc_id, line, 0 AS part, CASE WHEN h THEN t ELSE s || nl END AS text, a + CASE WHEN h THEN pre ELSE 0 END AS original_start FROM lk UNION ALL SELECT doc_id, line, 1, '.', a + pre + length(t) - 1 FROM lk WHERE h AND t NOT LIKE '%.' UNION ALL SELECT doc_id, line, 2, nl, a + length(s) FROM lk WHERE h),
    pi AS (SELECT doc_id, line, text, CAST(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY line, part) AS BIGINT) - length(text) AS filtered_start, CAST(original_start AS BIGINT) AS original_start, CAST(length(text) AS INTEGER) AS length FROM pc WHERE text <> '')"""


def _long_words(filtered):
    """Words of at least nine letters as spans, each linked to the one before it in its text."""
    w = written(tokens.tagged(tokens.tokenize(filtered, {"word": tokens.PATTERNS["word"]})).where("length(text) >= 9").select("doc_id", "start", "end", "text", F.col("pos").alias("annotation_type"), (F.col("idx") % 10 / 10.0).alias("confidence")), "words")
    order = W.partitionBy("doc_id").orderBy("start")
    links = w.select("doc_id", F.col("start").alias("source_start"), F.col("end").alias("source_end"), F.lag("start").over(order).alias("target_start"), F.lag("end").over(order).alias("target_end"), F.lit("FOLLOWS").alias("relation_type"))
    return w, links.where("target_start IS NOT NULL")


AUTO = PIECES + f""", fl AS (SELECT doc_id, string_agg(text, '' ORDER BY filtered_start) AS text FROM pi GROUP BY 1),
    fw AS (SELECT doc_id, unnest(ws) AS w, unnest(gs[1:len(ws)]) AS g, generate_subscripts(ws, 1) - 1 AS idx FROM (SELECT doc_id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+') AS ws, string_split_regex(text, '[\\p{{L}}\\p{{N}}]+') AS gs FROM fl)),
    ft AS (SELECT *, {TAGS} AS tag, CAST(sum(length(g) + length(w)) OVER (PARTITION BY doc_id ORDER BY idx) AS BIGINT) AS e FROM fw),
    fs AS (SELECT doc_id, idx % 10 / 10.0::DOUBLE AS confidence, {POS} AS pos, w, e - length(w) AS b, e, lag(idx % 10 / 10.0::DOUBLE) OVER q AS before_confidence, lag(e - length(w)) OVER q AS before_b FROM ft WHERE length(w) >= 9 WINDOW q AS (PARTITION BY doc_id ORDER BY idx)),
    fo AS (SELECT fs.*, pi.original_start + fs.b - pi.filtered_start AS o FROM fs ASOF JOIN pi ON fs.doc_id = pi.doc_id AND fs.b >= pi.filtered_start),
    fa AS (SELECT doc_id || '-' || o || '-' || (o + length(w)) || '-' || pos AS uid, doc_id, pos AS annotation_type, o AS start, o + length(w) AS "end", w AS text, 'auto' AS source, confidence, b, before_b, before_confidence FROM fo WHERE confidence >= 0.7)"""


def _auto(s, d):
    return an.auto_annotated(_drafts(s, d), _long_words)


def _paragraphs(s, d):
    """Documents with an empty line behind each sentence."""
    return table(s, d, "documents").select("doc_id", F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit(".\n\n")).alias("text"))


def _parts_of_source(s, d):
    """The documents in parts of 600 characters."""
    n = F.length(F.coalesce("text", F.lit("")))
    return table(s, d, "documents").select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(n / 600).cast("int"), F.lit(1)) - 1)).alias("chunk_no")).select("doc_id", "chunk_no", F.least(F.lit(600), F.col("n") - 600 * F.col("chunk_no")).alias("n_chars"))


def _noun_deps(s, d):
    """Words of sentences, and links of nouns that `and` joins: the second is conj of the first, and the `and` cc of the second."""
    w = sentence_words(s, d)
    order = W.partitionBy("doc_id", "sent_idx").orderBy("token_idx")
    at = F.col("token_idx")
    joins = w.select("*", F.lag("pos").over(order).alias("before"), F.lead("pos").over(order).alias("behind")).where("lower(text) = 'and' AND before = 'NOUN' AND behind = 'NOUN'")
    pair = F.array(F.struct((at - 1).alias("head"), (at + 1).alias("dependent"), F.lit("conj").alias("relation")), F.struct((at + 1).alias("head"), at.alias("dependent"), F.lit("cc").alias("relation")))
    return w, joins.select("doc_id", "sent_idx", F.explode(pair).alias("x")).select("doc_id", "sent_idx", "x.*")


def _coordinated(s, d):
    """The groups of each sentence and its first and last variant; all variants are too many where a sentence has many groups."""
    words, deps = _noun_deps(s, d)
    found = written(syntax.noun_groups(words, written(deps, "links")), "groups")
    ends = found.select("*", F.explode(F.array(F.struct(F.lit("first").alias("which"), F.transform("groups", lambda g: F.lit(0)).alias("digits")), F.struct(F.lit("last").alias("which"), F.transform("groups", lambda g: F.size(g) - 1).alias("digits")))).alias("x"))
    out = syntax.coordinated_variants(words, ends.select("doc_id", "sent_idx", "groups", "dropped", "x.*"))
    return out.select("doc_id", "sent_idx", "which", F.size("groups").alias("n_groups"), F.size(F.flatten("groups")).alias("n_nouns"), "text")


STAMP = "2024.01.31_12.00.00"


def _exported(s, d):
    """Long words as annotations, each related to the next one and every seventh to none; patterns of one source; pairs of verbs that follow each other."""
    a = written(_annotations(s, d).repartition("doc_id"), "annotations")
    order = W.partitionBy("doc_id").orderBy("start")
    a = a.withColumn("next", F.lead("uid").over(order))
    relations = a.where("next IS NOT NULL").select("doc_id", F.col("uid").alias("source_uid"), F.when(F.col("start") % 7 == 0, "none").otherwise(F.col("next")).alias("target_uid"), F.lit("NEXT").alias("relation_type"))
    verbs = a.where("annotation_type = 'VERB'").select("doc_id", F.col("text").alias("verb1"), F.lead("text").over(order).alias("verb2"), "confidence")
    parts = {"annotations": a.drop("next"), "relations": relations, "patterns": an.patterns(a, "multilevel"), "chains": verbs.where("verb2 IS NOT NULL").withColumn("sequence_type", F.lit("TEMPORAL"))}
    docs = table(s, d, "documents").select("doc_id", "lang", "source", F.when(F.col("doc_id") % 5 == 0, F.upper("text")).alias("user_text"), F.lit(None).cast("string").alias("formatted_text"), F.when(F.col("doc_id") % 11 > 0, F.col("text")).alias("raw_text"))
    path = scratch(s, "dataset")
    return path, datasets.export_dataset(path, docs, parts, STAMP)


def _imported(s, d):
    """(doc_id, part, n) of all that comes back, relations left out among it."""
    out = datasets.import_dataset(s, _exported(s, d)[0])
    frames = None
    for name in ("metadata", "texts", "annotations", "relations", "skipped", "chains", "patterns"):
        rows = out[name].groupBy("doc_id").agg(F.count("*").alias("n")).withColumn("part", F.lit(name))
        frames = rows if frames is None else frames.unionByName(rows)
    values = out["properties"].join(out["patterns"].select("pattern_id", "doc_id").distinct(), "pattern_id").groupBy("doc_id").agg(F.count("*").alias("n")).withColumn("part", F.lit("properties"))
    return frames.unionByName(values).select("doc_id", "part", "n")


SAMPLES = f"""{ANN}, al AS (SELECT *, lead(uid) OVER (PARTITION BY doc_id ORDER BY start) AS nxt FROM an), vb AS (SELECT doc_id, lead(uid) OVER (PARTITION BY doc_id ORDER BY start) AS nv FROM an WHERE annotation_type = 'VERB'),
    n1 AS (SELECT doc_id, count(*) AS annotations, count(nxt) AS relations, count(*) FILTER (nxt IS NOT NULL AND start % 7 = 0) AS skipped, count(*) FILTER (source = 'multilevel') AS patterns FROM al GROUP BY 1), n2 AS (SELECT doc_id, count(nv) AS chains FROM vb GROUP BY 1),
    sm AS (SELECT doc_id, doc_id || '_{STAMP}_' || substr(md5(doc_id || ':0'), 1, 6) AS sample_id, CAST(CASE WHEN text IS NOT NULL AND (doc_id % 5 = 0 OR doc_id % 11 > 0) THEN 1 ELSE 0 END AS BIGINT) AS text, coalesce(annotations, 0) AS annotations, coalesce(relations, 0) AS relations, coalesce(skipped, 0) AS skipped, coalesce(patterns, 0) AS patterns, coalesce(chains, 0) AS chains
        FROM documents LEFT JOIN n1 USING (doc_id) LEFT JOIN n2 USING (doc_id)),
    sx AS (SELECT *, concat_ws(',', CASE WHEN text = 0 THEN 'text' END, CASE WHEN patterns = 0 THEN 'patterns' END, CASE WHEN chains = 0 THEN 'chains' END) AS missing FROM sm)"""

QUERIES = {
    "text_markdown_pieces": lambda s, d: text.markdown_pieces(_drafts(s, d)),
    "text_split_like": lambda s, d: text.split_like(_paragraphs(s, d), _parts_of_source(s, d)).select("doc_id", "chunk_no", "start", "end", F.md5("text").alias("hash")),
    "text_coordinated_nouns": _coordinated,
    "annotations_auto": lambda s, d: _auto(s, d)[0],
    "annotations_auto_relations": lambda s, d: _auto(s, d)[1],
    "dataset_manifest": lambda s, d: _exported(s, d)[1],
    "dataset_imported": _imported,
}

_NUMBERS = "unnest([{}]) AS part, unnest([{}]) AS n"
_PARTS = ("metadata", "texts", "annotations", "relations", "skipped", "chains", "patterns", "properties")
_VALUES = ("1", "1", "annotations", "relations - skipped", "skipped", "chains", "patterns", "3 * patterns")

ORACLE_SQL = {
    "text_markdown_pieces": f"WITH {PIECES} SELECT * FROM pi",
    "text_split_like": """WITH RECURSIVE b AS (SELECT doc_id, replace(coalesce(text, ''), '. ', '.' || chr(10) || chr(10)) AS t, length(coalesce(text, '')) AS n FROM documents), p AS (SELECT *, greatest(CAST(ceil(n / 600.0) AS INTEGER), 1) AS parts FROM b),
        r AS (SELECT doc_id, t, n, parts, -1 AS i, 0 AS "start", 0 AS "end" FROM p UNION ALL
            SELECT doc_id, t, n, parts, i, b, CASE WHEN i = parts - 1 THEN length(t) WHEN lo + back > b AND back > 0 THEN lo + back ELSE c END FROM (
                SELECT *, CASE WHEN contains(near, chr(10) || chr(10)) THEN length(near) - length(string_split(near, chr(10) || chr(10))[-1]) ELSE 0 END AS back FROM (
                    SELECT *, greatest(c - 200, 0) AS lo, substr(t, greatest(c - 200, 0) + 1, least(c + 200, length(t)) - greatest(c - 200, 0)) AS near FROM (
                        SELECT doc_id, t, n, parts, i + 1 AS i, "end" AS b, least("end" + CASE WHEN n > 0 THEN length(t) * least(600, n - 600 * (i + 1)) // n ELSE length(t) // parts END, length(t)) AS c FROM r WHERE i + 1 < parts))))
        SELECT doc_id, CAST(i AS INTEGER) AS chunk_no, CAST("start" AS INTEGER) AS "start", CAST("end" AS INTEGER) AS "end", md5(substr(t, "start" + 1, "end" - "start")) AS hash FROM r WHERE i >= 0""",
    "text_coordinated_nouns": f"""WITH {SW}, j AS (SELECT *, coalesce(lower(text) = 'and' AND lag(pos) OVER o = 'NOUN' AND lead(pos) OVER o = 'NOUN', false) AS joins FROM sw WINDOW o AS (PARTITION BY doc_id, sent_idx ORDER BY token_idx)),
        g AS (SELECT *, coalesce(lag(joins) OVER o, false) AS after_join, coalesce(lead(joins) OVER o, false) AS before_join FROM j WINDOW o AS (PARTITION BY doc_id, sent_idx ORDER BY token_idx)),
        x AS (SELECT *, pos = 'NOUN' AND (after_join OR before_join) AS member, pos = 'NOUN' AND before_join AND NOT after_join AS opens, pos = 'NOUN' AND after_join AND NOT before_join AS closes FROM g),
        s AS (SELECT doc_id, sent_idx, count(*) FILTER (opens) AS n_groups, count(*) FILTER (member) AS n_nouns, string_agg(text, ' ' ORDER BY token_idx) FILTER (NOT joins AND (NOT member OR opens)) AS a, string_agg(text, ' ' ORDER BY token_idx) FILTER (NOT joins AND (NOT member OR closes)) AS z FROM x GROUP BY 1, 2 HAVING bool_or(joins))
        SELECT doc_id, sent_idx, unnest(['first', 'last']) AS which, CAST(n_groups AS INTEGER) AS n_groups, CAST(n_nouns AS INTEGER) AS n_nouns, unnest([a, z]) AS text FROM s""",
    "annotations_auto": f'WITH {AUTO} SELECT uid, doc_id, annotation_type, start, "end", text, source, confidence FROM fa',
    "annotations_auto_relations": f"WITH {AUTO} SELECT a.uid AS source_uid, b.uid AS target_uid, 'FOLLOWS' AS relation_type FROM fa a JOIN fa b ON b.doc_id = a.doc_id AND b.b = a.before_b",
    "dataset_manifest": f"WITH {SAMPLES} SELECT doc_id, sample_id, text, annotations, relations, patterns, chains, missing FROM sx",
    "dataset_imported": f"WITH {SAMPLES}, ux AS (SELECT doc_id, {_NUMBERS.format(', '.join(repr(p) for p in _PARTS), ', '.join(_VALUES))} FROM sx WHERE missing = '') SELECT doc_id, part, CAST(n AS BIGINT) AS n FROM ux WHERE n > 0",
}
