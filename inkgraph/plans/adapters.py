"""The given tables as the library's inputs: an edge list, articles, tokens, annotations; and the same as SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from inkgraph.operators import chains, tokens
from inkgraph.operators.cutting import text_parts
from inkgraph.operators.sentences import words_in_sentences
from inkgraph.plans.scratch import dealt, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dag_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of five layers, some repeated: region, nation, customer and supplier, orders, part."""
    parts = [
        ("nation", "R", "n_regionkey", "N", "n_nationkey"),
        ("customer", "N", "c_nationkey", "C", "c_custkey"),
        ("orders", "C", "o_custkey", "O", "o_orderkey"),
        ("lineitem", "O", "l_orderkey", "P", "l_partkey"),
        ("supplier", "N", "s_nationkey", "S", "s_suppkey"),
        ("lineitem", "S", "l_suppkey", "P", "l_partkey"),
    ]
    frames = [table(spark, sf_dir, name).select(F.concat(F.lit(p), F.col(a)).alias("src"), F.concat(F.lit(q), F.col(b)).alias("dst")) for name, p, a, q, b in parts]
    return reduce(DataFrame.unionByName, frames)


def dag_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct links."""
    return dag_links(spark, sf_dir).distinct()


EDGES = """e AS (
    SELECT 'R' || n_regionkey AS src, 'N' || n_nationkey AS dst FROM nation UNION
    SELECT 'N' || c_nationkey, 'C' || c_custkey FROM customer UNION
    SELECT 'C' || o_custkey, 'O' || o_orderkey FROM orders UNION
    SELECT 'O' || l_orderkey, 'P' || l_partkey FROM lineitem UNION
    SELECT 'N' || s_nationkey, 'S' || s_suppkey FROM supplier UNION
    SELECT 'S' || l_suppkey, 'P' || l_partkey FROM lineitem)"""

LAYERS = EDGES + """, r AS (
    SELECT DISTINCT src AS v, 0 AS layer FROM e WHERE src NOT IN (SELECT dst FROM e)
    UNION SELECT e.dst, r.layer + 1 FROM r JOIN e ON e.src = r.v
), l AS (SELECT v, max(layer) AS layer FROM r GROUP BY v)"""

PLACED = LAYERS + """, p AS (
    SELECT v, layer, CAST(row_number() OVER (PARTITION BY layer ORDER BY v) - 1 AS INTEGER) AS level FROM l
), xy AS (SELECT *, layer * 240.0::DOUBLE AS x, level * 130.0::DOUBLE AS y FROM p)"""


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, title, journal, year, doi, abstract, authors, keywords from documents; some values are left out by rule."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    return d.select(
        F.concat(F.lit("D"), k).alias("uid"),
        F.when(k % 17 != 0, F.substring_index("text", "\n", 1)).alias("title"),
        F.when(k % 17 != 0, F.col("source")).alias("journal"),
        (1990 + k % 30).cast("string").alias("year"),
        F.when(k % 3 == 0, F.concat(F.lit("10.1000/"), k)).alias("doi"),
        F.when(k % 17 != 0, F.substring("text", 1, 200)).alias("abstract"),
        F.when(k % 17 != 0, F.slice(F.split("text", " "), 1, (k % 6).cast("int"))).otherwise(F.array().cast("array<string>")).alias("authors"),
        F.slice(F.split("text", " "), 7, (k % 4).cast("int")).alias("keywords"),
    )


ARTICLES = """a AS (
    SELECT 'D' || doc_id AS uid, CASE WHEN doc_id % 17 <> 0 THEN split_part(text, chr(10), 1) END AS title,
        CASE WHEN doc_id % 17 <> 0 THEN source END AS journal, CAST(1990 + doc_id % 30 AS VARCHAR) AS year,
        CASE WHEN doc_id % 3 = 0 THEN '10.1000/' || doc_id END AS doi, CASE WHEN doc_id % 17 <> 0 THEN substr(text, 1, 200) END AS abstract,
        CASE WHEN doc_id % 17 <> 0 THEN string_split(text, ' ')[1:doc_id % 6] ELSE [] END AS authors,
        string_split(text, ' ')[7:6 + doc_id % 4] AS keywords
    FROM documents)"""


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document cites those with half and a third of its id; some rows are blank, loops or repeats."""
    k = F.col("doc_id")
    name = lambda c: F.concat(F.lit("D"), c.cast("long"))
    rows = F.array(
        F.struct(name(F.floor(k / 2)).alias("src"), name(k).alias("dst")),
        F.struct(name(F.floor(k / 3)).alias("src"), name(k).alias("dst")),
        F.struct(F.when(k % 11 == 0, F.lit(" ")).otherwise(name(F.floor(k / 2))).alias("src"), F.when(k % 13 == 0, F.lit(None).cast("string")).otherwise(name(k)).alias("dst")),
    )
    return table(spark, sf_dir, "documents").select(F.explode(rows).alias("e")).select("e.*")


CITATIONS = """c AS (
    SELECT 'D' || (doc_id // 2) AS src, 'D' || doc_id AS dst FROM documents UNION ALL
    SELECT 'D' || (doc_id // 3), 'D' || doc_id FROM documents UNION ALL
    SELECT CASE WHEN doc_id % 11 = 0 THEN ' ' ELSE 'D' || (doc_id // 2) END, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE 'D' || doc_id END FROM documents)"""

CLEAN = CITATIONS + ", k AS (SELECT DISTINCT src, dst FROM c WHERE trim(src) <> '' AND trim(dst) <> '' AND src <> dst)"


TAGS = """CASE WHEN NOT regexp_matches(w, '[\\p{L}\\p{N}]') THEN '.' WHEN regexp_matches(w, '^\\p{N}+$') THEN 'CD' WHEN lower(w) IN ('the','a','an','this','that') THEN 'DT' WHEN lower(w) IN ('and','or') THEN 'CC'
    WHEN lower(w) IN ('of','to','in','for','with','on','by','from','at','as') THEN 'IN' WHEN lower(w) LIKE '%ing' THEN 'VBG' WHEN lower(w) LIKE '%ed' THEN 'VBD' WHEN lower(w) LIKE '%ly' THEN 'RB' WHEN lower(w) LIKE '%ble' THEN 'JJ' WHEN lower(w) LIKE '%es' THEN 'NNS' ELSE 'NN' END"""
POS = "CASE tag WHEN 'NN' THEN 'NOUN' WHEN 'NNS' THEN 'NOUN' WHEN 'VBG' THEN 'VERB' WHEN 'VBD' THEN 'VERB' WHEN 'JJ' THEN 'ADJ' WHEN 'RB' THEN 'ADV' WHEN 'DT' THEN 'DET' WHEN 'IN' THEN 'ADP' WHEN 'CC' THEN 'CCONJ' WHEN 'CD' THEN 'NUM' WHEN '.' THEN 'PUNCT' ELSE 'X' END"
#: Words that the rule tagger takes for auxiliaries in sentences.
AUXILIARY = ["is", "are", "was", "were", "be", "been", "has", "have", "had", "will", "can", "may"]


def _words(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Words of documents in sentences with their heads. A text is cut, tagged and parsed in its own row, so that no word is shuffled or sorted."""
    documents = table(spark, sf_dir, "documents")
    texts = documents.select("doc_id", "text").repartition(parts or text_parts(documents), "doc_id")
    return words_in_sentences(texts, AUXILIARY)


def _with_heads(rows: DataFrame) -> DataFrame:
    at, pos, root = F.col("token_idx"), F.col("pos"), F.col("root")
    last = F.col("next_noun") & ~F.col("second_noun")
    relation = (
        F.when(at == root, "root").when((pos == "VERB") & F.col("after_to"), "xcomp").when((pos == "VERB") & (F.col("tag") == "VBG"), "advcl").when(pos == "VERB", "conj").when(pos == "AUX", "aux")
        .when((pos == "NOUN") & F.col("after_adp"), "obl").when((pos == "NOUN") & last, "compound").when((pos == "NOUN") & (at < root), "nsubj").when(pos == "NOUN", "obj")
        .when(pos == "ADJ", "amod").when(pos == "DET", "det").when(pos == "ADP", "case").when(pos == "CCONJ", "cc").when(pos == "NUM", "nummod").when(pos == "ADV", "advmod").otherwise("dep")
    )
    out = rows.withColumn("relation", F.when(root.isNotNull(), relation))
    onward = F.col("relation").isin("amod", "det", "case", "cc", "nummod", "compound") & F.col("next_noun")
    head, head_pos = F.when(onward, at + 1).otherwise(root), F.when(onward, "NOUN").when(root.isNotNull(), "VERB")
    return out.withColumn("head", head).withColumn("head_pos", head_pos).select("doc_id", "sent_idx", "token_idx", "idx", "text", "tag", "pos", "start", "end", "head", "relation", "head_pos", "gap")


#: The sentence tables and their numbers of buckets by application and input folder.
_sentences: dict[tuple[str, str], tuple[DataFrame, int]] = {}


def _stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _sentences:
        parts = text_parts(table(spark, sf_dir, "documents"))
        _sentences[key] = dealt(_with_heads(_words(spark, sf_dir, parts)), "sentences", "doc_id", parts), parts
    # joins by document, sentence and place may take their rows as they lie, by document
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return _sentences[key]


def sentence_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents in sentences with their heads, written once in an application: all operators of a query, and later queries, read the same table.

    It lies in buckets by document, as many as the texts are large: what goes by document or sentence needs no shuffle of words, and a task's share does not grow with the input.
    """
    return _stored(spark, sf_dir)[0]


def sentence_parts(spark: SparkSession, sf_dir: str) -> int:
    """Buckets of the sentence table."""
    return _stored(spark, sf_dir)[1]


def sentence_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, sent_idx, token_idx, idx, text, tag, pos, start, end): words of documents with their sentence; a gap with . ! ? and white space ends one."""
    return sentence_table(spark, sf_dir).drop("head", "relation", "head_pos", "gap")


def words_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sentence_words with gap: what stands between the word before and this one."""
    return sentence_table(spark, sf_dir).drop("head", "relation", "head_pos")


SW = f"""sw0 AS (SELECT doc_id, unnest(ws) AS w, unnest(gs[1:len(ws)]) AS g, generate_subscripts(ws, 1) - 1 AS idx FROM (SELECT doc_id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+') AS ws, string_split_regex(text, '[\\p{{L}}\\p{{N}}]+') AS gs FROM documents)),
    sw1 AS (SELECT *, {TAGS} AS tag, CAST(sum(length(g) + length(w)) OVER o AS BIGINT) AS e, CAST(sum(CASE WHEN regexp_matches(g, '[.!?]\\s') THEN 1 ELSE 0 END) OVER o AS BIGINT) AS sent_idx FROM sw0 WINDOW o AS (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING)),
    sw AS (SELECT doc_id, sent_idx, CAST(row_number() OVER (PARTITION BY doc_id, sent_idx ORDER BY idx) - 1 AS INTEGER) AS token_idx, CAST(idx AS INTEGER) AS idx, w AS text, tag, CASE WHEN lower(w) IN ({", ".join(f"'{x}'" for x in AUXILIARY)}) THEN 'AUX' ELSE {POS} END AS pos, e - length(w) AS start, e AS "end" FROM sw1)"""


def sentence_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, sent_idx, head, dependent, relation, dependent_text, dependent_pos, head_pos) by rules: the first verb is the root, and what stands before and behind a word names its relation. The words' own columns spare joins with them."""
    return sentence_table(spark, sf_dir).where("relation IS NOT NULL").select("doc_id", "sent_idx", "head", F.col("token_idx").alias("dependent"), "relation", F.col("text").alias("dependent_text"), F.col("pos").alias("dependent_pos"), "head_pos")


SD = """sd0 AS (SELECT *, min(CASE WHEN pos = 'VERB' THEN token_idx END) OVER (PARTITION BY doc_id, sent_idx) AS root, lag(lower(text)) OVER o AS pl, lag(pos) OVER o AS pp, lead(pos) OVER o AS np, lead(pos, 2) OVER o AS nn FROM sw WINDOW o AS (PARTITION BY doc_id, sent_idx ORDER BY token_idx)),
    sd1 AS (SELECT *, CASE WHEN token_idx = root THEN 'root' WHEN pos = 'VERB' AND pl = 'to' THEN 'xcomp' WHEN pos = 'VERB' AND tag = 'VBG' THEN 'advcl' WHEN pos = 'VERB' THEN 'conj' WHEN pos = 'AUX' THEN 'aux' WHEN pos = 'NOUN' AND pp = 'ADP' THEN 'obl' WHEN pos = 'NOUN' AND np = 'NOUN' AND coalesce(nn, '') <> 'NOUN' THEN 'compound' WHEN pos = 'NOUN' AND token_idx < root THEN 'nsubj' WHEN pos = 'NOUN' THEN 'obj'
        WHEN pos = 'ADJ' THEN 'amod' WHEN pos = 'DET' THEN 'det' WHEN pos = 'ADP' THEN 'case' WHEN pos = 'CCONJ' THEN 'cc' WHEN pos = 'NUM' THEN 'nummod' WHEN pos = 'ADV' THEN 'advmod' ELSE 'dep' END AS relation FROM sd0 WHERE root IS NOT NULL),
    sd AS (SELECT doc_id, sent_idx, CASE WHEN relation IN ('amod','det','case','cc','nummod','compound') AND np = 'NOUN' THEN token_idx + 1 ELSE root END AS head, token_idx AS dependent, relation, text, pos, idx FROM sd1)"""


def dependencies_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, relation, confidence, marker): parts as actions, each followed by the part of the next line of its order."""
    li = table(spark, sf_dir, "lineitem")
    after = F.lead("l_partkey").over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    rows = li.select(F.col("l_partkey").cast("string").alias("src"), after.cast("string").alias("dst"), F.when(F.col("l_linenumber") == 1, "CAUSES").when(F.col("l_linenumber") == 2, "PURPOSE").otherwise("BEFORE").alias("relation"), F.round(F.col("l_quantity") / 50, 4).alias("confidence"), F.col("l_returnflag").alias("marker"))
    return rows.where("dst IS NOT NULL AND src <> dst")


DEPS = "d AS (SELECT * FROM (SELECT CAST(l_partkey AS VARCHAR) AS src, CAST(lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS VARCHAR) AS dst, CASE l_linenumber WHEN 1 THEN 'CAUSES' WHEN 2 THEN 'PURPOSE' ELSE 'BEFORE' END AS relation, round(l_quantity / 50, 4) AS confidence, l_returnflag AS marker FROM lineitem) WHERE dst IS NOT NULL AND src <> dst)"


def resolved_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sure ones of them, one for each pair, from smaller to larger ids: an acyclic graph."""
    found = chains.resolve_conflicts(dependencies_of_parts(spark, sf_dir), {"CAUSES": 3, "PURPOSE": 2, "BEFORE": 1})
    return written(found.where("confidence > 0.9 AND src < dst"), "deps")


RESOLVED = DEPS + ", q AS (SELECT *, CASE relation WHEN 'CAUSES' THEN 3 WHEN 'PURPOSE' THEN 2 ELSE 1 END AS p FROM d), b AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY p DESC, confidence DESC, relation DESC) AS r FROM q), x AS (SELECT src, dst, relation, confidence FROM b WHERE r = 1 AND confidence > 0.9 AND src < dst)"
