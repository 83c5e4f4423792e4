"""Dependency tables (doc_id, sent_idx, head, dependent, relation) joined to tokens (doc_id, sent_idx, token_idx, text, pos)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["doc_id", "sent_idx"]


def _worded(tokens: DataFrame, deps: DataFrame) -> DataFrame:
    """Dependencies with dependent_text and dependent_pos; those that bring them need no join."""
    if {"dependent_text", "dependent_pos"} <= set(deps.columns):
        return deps
    return deps.drop("dependent_text", "dependent_pos").join(tokens.select(*KEYS, F.col("token_idx").alias("dependent"), F.col("text").alias("dependent_text"), F.col("pos").alias("dependent_pos")), [*KEYS, "dependent"])


def _headed(tokens: DataFrame, deps: DataFrame, pos: str) -> DataFrame:
    """Dependencies whose head has that part of speech."""
    if "head_pos" in deps.columns:
        return deps.where(F.col("head_pos") == pos)
    return deps.join(tokens.where(F.col("pos") == pos).select(*KEYS, F.col("token_idx").alias("head")), [*KEYS, "head"], "left_semi")


def roots(deps: DataFrame) -> DataFrame:
    """(doc_id, sent_idx, token_idx) of tokens with relation root."""
    return deps.where("relation = 'root'").select(*KEYS, F.col("dependent").alias("token_idx"))


def dependents(deps: DataFrame) -> DataFrame:
    """(doc_id, sent_idx, head, dependents) as positions in order."""
    return deps.where("relation <> 'root'").groupBy(*KEYS, "head").agg(F.array_sort(F.collect_set("dependent")).alias("dependents"))


def subject_verb_object(tokens: DataFrame, deps: DataFrame) -> DataFrame:
    """(doc_id, sent_idx, verb, subject, object) of root verbs; the last subject and object by position."""
    worded = _worded(tokens, deps.where("relation IN ('root', 'nsubj', 'obj')"))
    last = lambda rel: F.max(F.when(F.col("relation") == rel, F.struct("dependent", "dependent_text")))["dependent_text"]
    arguments = worded.where("relation <> 'root'").groupBy(*KEYS, F.col("head").alias("token_idx")).agg(last("nsubj").alias("subject"), last("obj").alias("object"))
    verbs = worded.where("relation = 'root' AND dependent_pos = 'VERB'").select(*KEYS, F.col("dependent").alias("token_idx"), F.col("dependent_text").alias("verb"))
    return verbs.join(arguments, [*KEYS, "token_idx"], "left").select(*KEYS, "verb", "subject", "object")


def sentences_with(deps: DataFrame, relations: list[str]) -> DataFrame:
    """Sentences that have every relation, with how many matching pairs."""
    hits = deps.where(F.col("relation").isin(relations)).groupBy(*KEYS).agg(F.countDistinct("relation").alias("k"), F.count("*").alias("pairs"))
    return hits.where(F.col("k") == len(set(relations))).select(*KEYS, "pairs")


def verb_phrases(tokens: DataFrame, deps: DataFrame) -> DataFrame:
    """(doc_id, sent_idx, verb, start, end): a verb with its auxiliaries and negations, as a span of positions."""
    verbs = tokens.where("pos = 'VERB'").select(*KEYS, F.col("token_idx").alias("head"))
    own = deps.where(F.col("relation").isin("aux", "auxpass", "aux:pass", "neg", "prt")).join(verbs, [*KEYS, "head"]).select(*KEYS, "head", F.col("dependent").alias("i"))
    return own.unionByName(verbs.withColumn("i", F.col("head"))).groupBy(*KEYS, F.col("head").alias("verb")).agg(F.min("i").alias("start"), (F.max("i") + 1).alias("end"))


def relation_distribution(deps: DataFrame, most: int = 15) -> DataFrame:
    return deps.groupBy("relation").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "relation").limit(most)


def direct_verb_links(tokens: DataFrame, deps: DataFrame) -> DataFrame:
    """(doc_id, sent_idx, a, b, relation): verbs joined by xcomp, ccomp, advcl or conj, in either direction."""
    found = _headed(tokens, _worded(tokens, deps.where(F.col("relation").isin("xcomp", "ccomp", "advcl", "conj"))).where("dependent_pos = 'VERB'"), "VERB")
    return found.groupBy(*KEYS, F.least("head", "dependent").alias("a"), F.greatest("head", "dependent").alias("b")).agg(F.min("relation").alias("relation"))


def linked_arguments(entities: DataFrame, arguments: DataFrame) -> DataFrame:
    """(doc_id, sent_idx, entity, verb, relation): entities whose text is part of a verb's subject or object."""
    roles = F.array(F.struct(F.lit("LINKED_AS_SUBJECT").alias("relation"), F.col("subject").alias("arg")), F.struct(F.lit("LINKED_AS_OBJECT").alias("relation"), F.col("object").alias("arg")))
    args = arguments.select(*KEYS, "verb", F.explode(roles).alias("r")).select(*KEYS, "verb", "r.*").where("arg IS NOT NULL")
    return entities.join(args, KEYS).where(F.lower("arg").contains(F.lower("entity"))).select(*KEYS, "entity", "verb", "relation").distinct()


def clauses(tokens: DataFrame, deps: DataFrame, parts: int | None = None) -> DataFrame:
    """(doc_id, sent_idx, verb, subtree, dependents): each verb with the positions of all tokens under it, itself included, and of its own dependents.

    All tokens go up one edge at a time; as many rounds as the deepest tree has levels. Where the inputs lie in `parts`
    buckets by doc_id, so does what a round puts down, and no round shuffles.
    """
    from inkgraph.plans.scratch import dealt, written

    put = written if parts is None else lambda rows, name: dealt(rows, name, "doc_id", parts)
    up = put(deps.where("head <> dependent").select(*KEYS, "dependent", "head"), "up")
    front = up.select(*KEYS, "dependent", F.col("head").alias("verb"))
    ways = front
    for _ in range(1000):
        front = put(front.join(up.select(*KEYS, F.col("dependent").alias("verb"), "head").hint("merge"), [*KEYS, "verb"]).where("head <> dependent").select(*KEYS, "dependent", F.col("head").alias("verb")), "front")
        if front.isEmpty():
            break
        ways = ways.unionByName(front)
    verbs = tokens.where("pos = 'VERB'").select(*KEYS, F.col("token_idx").alias("verb"))
    under = ways.join(verbs.hint("merge"), [*KEYS, "verb"], "left_semi").select(*KEYS, "verb", F.col("dependent").alias("i")).unionByName(verbs.withColumn("i", F.col("verb")))
    trees = under.groupBy(*KEYS, "verb").agg(F.array_sort(F.collect_set("i")).alias("subtree"))
    own = deps.where("head <> dependent").groupBy(*KEYS, F.col("head").alias("verb")).agg(F.array_sort(F.collect_set("dependent")).alias("dependents"))
    return trees.join(own.hint("merge"), [*KEYS, "verb"], "left").select(*KEYS, "verb", F.array_join("subtree", ",").alias("subtree"), F.coalesce(F.array_join("dependents", ","), F.lit("")).alias("dependents"))


def noun_phrases(tokens: DataFrame, deps: DataFrame) -> DataFrame:
    """(doc_id, sent_idx, noun, phrase): a noun with its amod, compound, det and nummod children and its conj children with their cc, in token order."""
    nouns = tokens.where("pos = 'NOUN'").select(*KEYS, F.col("token_idx").alias("noun"), F.col("token_idx").alias("i"), "text")
    worded = _worded(tokens, deps.where("relation IN ('amod', 'compound', 'det', 'nummod', 'conj', 'cc')"))
    direct = _headed(tokens, worded.where("relation <> 'cc'"), "NOUN").select(*KEYS, F.col("head").alias("noun"), F.col("dependent").alias("i"), F.col("dependent_text").alias("text"), "relation")
    cc = direct.where("relation = 'conj'").select(*KEYS, "noun", F.col("i").alias("head")).join(worded.where("relation = 'cc'").select(*KEYS, "head", F.col("dependent").alias("i"), F.col("dependent_text").alias("text")), [*KEYS, "head"]).select(*KEYS, "noun", "i", "text")
    members = nouns.unionByName(direct.drop("relation")).unionByName(cc)
    return members.groupBy(*KEYS, "noun").agg(F.array_sort(F.collect_set(F.struct("i", "text"))).alias("w")).select(*KEYS, "noun", F.array_join(F.transform("w", lambda x: x["text"]), " ").alias("phrase"))


def verb_phrase_texts(tokens: DataFrame, deps: DataFrame) -> DataFrame:
    """(doc_id, sent_idx, verb, phrase): the words of a verb phrase's span in order."""
    spans = verb_phrases(tokens, deps)
    places = spans.select(*KEYS, "verb", F.explode(F.sequence("start", F.col("end") - 1)).alias("token_idx"))
    words = places.join(tokens.select(*KEYS, "token_idx", "text"), [*KEYS, "token_idx"])
    return words.groupBy(*KEYS, "verb").agg(F.array_sort(F.collect_list(F.struct("token_idx", "text"))).alias("w")).select(*KEYS, "verb", F.array_join(F.transform("w", lambda x: x["text"]), " ").alias("phrase"))


def entities_of_types(entities: DataFrame, types: list[str]) -> DataFrame:
    """Entities of the given types, in any case."""
    return entities.where(F.lower("entity_type").isin([t.lower() for t in types]))


def noun_groups(tokens: DataFrame, deps: DataFrame) -> DataFrame:
    """(doc_id, sent_idx, groups, dropped): coordinated nouns of a sentence as arrays of token places, in order, and the places of the `and` between them.

    Nouns that conj links join, over words of any kind between them, are a group if there are two or more and an `and` depends by cc on one of them.
    tokens: doc_id, sent_idx, token_idx, text, pos; deps: doc_id, sent_idx, head, dependent, relation, each dependent once. conj links that
    go backwards are not followed. Sentences without a group have no row.
    """
    keys = ["doc_id", "sent_idx"]
    links = deps.where("relation = 'conj' AND head < dependent").groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("dependent", "head"))).alias("links"))
    first = lambda found, place: F.coalesce(F.element_at(found, place), place)
    # links in order of their dependent: the root of a head is known when its dependents come
    roots = F.aggregate("links", F.create_map().cast("map<int,int>"), lambda found, x: F.map_concat(found, F.create_map(x["dependent"], first(found, x["head"]))))
    chain = links.select(*keys, F.explode(roots).alias("token_idx", "root"))
    members = chain.unionByName(chain.select(*keys, F.col("root").alias("token_idx"), "root")).distinct()
    nouns = members.join(tokens.where("pos = 'NOUN'").select(*keys, "token_idx"), [*keys, "token_idx"])
    ands = deps.where("relation = 'cc'").select(*keys, F.col("head").alias("token_idx"), F.col("dependent").alias("and_idx")).join(tokens.where("lower(text) = 'and'").select(*keys, F.col("token_idx").alias("and_idx")), [*keys, "and_idx"])
    marked = nouns.join(ands, [*keys, "token_idx"], "left").groupBy(*keys, "root").agg(F.array_sort(F.collect_set("token_idx")).alias("group"), F.array_sort(F.collect_set("and_idx")).alias("ands"))
    return marked.where((F.size("group") > 1) & (F.size("ands") > 0)).groupBy(*keys).agg(F.array_sort(F.collect_list("group")).alias("groups"), F.flatten(F.collect_list("ands")).alias("dropped"))


def coordinated_variants(tokens: DataFrame, choices: DataFrame) -> DataFrame:
    """choices (doc_id, sent_idx, groups, dropped, digits and any columns) with the text of the sentence in which digits[i] names the noun kept of group i.

    The other nouns of the groups and the `and` between them go. tokens may have `gap`, the white space behind a token; without it, a space.
    """
    keys = ["doc_id", "sent_idx"]
    gap = F.coalesce("gap", F.lit("")) if "gap" in tokens.columns else F.lit(" ")
    words = tokens.join(choices.select(*keys).distinct(), keys, "left_semi").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("token_idx", F.concat("text", gap).alias("text")))).alias("words"))
    chosen = F.transform("groups", lambda g, i: F.get(g, F.get("digits", i)))
    rows = choices.join(words, keys).withColumn("gone", F.concat(F.array_except(F.flatten("groups"), chosen), "dropped"))
    kept = F.filter("words", lambda w: ~F.array_contains("gone", w["token_idx"]))
    return rows.select(*choices.columns, F.trim(F.array_join(F.transform(kept, lambda w: w["text"]), "")).alias("text"))


def split_coordinated(tokens: DataFrame, groups: DataFrame) -> DataFrame:
    """(doc_id, sent_idx, variant, text): each sentence with coordinated nouns once for each choice of one noun from every group.

    Variants are numbered in mixed radix, the last group fastest, and all come from one `sequence`: the digits of a
    variant follow from its number, so no table of choices is joined. A sentence makes as many rows as the product of its groups' sizes; one
    with 2^31 or more raises, and its variants can be had one by one from `coordinated_variants`.
    """
    radix = F.transform("groups", lambda g, i: F.aggregate(F.slice("groups", i + 2, F.size("groups")), F.lit(1).cast("long"), lambda n, h: n * F.size(h)))
    rows = groups.withColumn("radix", radix)
    rows = rows.withColumn("variant", F.explode(F.sequence(F.lit(0).cast("long"), F.get("radix", F.lit(0)) * F.size(F.get("groups", F.lit(0))) - 1)))
    digits = F.transform("groups", lambda g, i: (F.floor(F.col("variant") / F.get("radix", i)) % F.size(g)).cast("int"))
    return coordinated_variants(tokens, rows.withColumn("digits", digits).drop("radix")).select("doc_id", "sent_idx", "variant", "text")
