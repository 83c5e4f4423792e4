"""Action chains: verbs of a text, pairs that follow from each other, and actions with dependencies."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from inkgraph.plans.scratch import dealt, written

KEYS = ["doc_id", "sent_idx"]
#: Words that mark a sequence, and its type.
MARKERS = {
    "after": "TEMPORAL_AFTER", "then": "TEMPORAL_AFTER", "next": "TEMPORAL_AFTER", "following": "TEMPORAL_AFTER", "subsequently": "TEMPORAL_AFTER",
    "before": "TEMPORAL_BEFORE", "previously": "TEMPORAL_BEFORE", "first": "TEMPORAL_BEFORE", "finally": "TEMPORAL_AFTER",
    "because": "CAUSAL", "therefore": "RESULT", "thus": "RESULT", "consequently": "RESULT", "hence": "RESULT",
    "to": "PURPOSE", "in order to": "PURPOSE", "so that": "PURPOSE",
}
#: The type of a sequence that a dependency makes, and all types.
BY_DEPENDENCY = {"xcomp": "PURPOSE", "advcl": "TEMPORAL_AFTER", "ccomp": "RESULT", "conj": "COORDINATION"}
TYPES = ["TEMPORAL_AFTER", "TEMPORAL_BEFORE", "CAUSAL", "PURPOSE", "RESULT", "COORDINATION", "SEQUENTIAL"]
#: What evidence of a pair counts, and what it takes.
DEPENDENCY, MARKER, SHARED, SAME_SENTENCE, ADJACENT, LEAST = 0.7, 0.6, 0.3, 0.15, 0.2, 0.7


def _arguments(tokens: DataFrame, deps: DataFrame) -> DataFrame:
    """(doc_id, sent_idx, token_idx, subject, object, entities) of heads: the first nsubj and obj child, and all entities: these and the obl, iobj, xcomp and ccomp children."""
    child = deps.where("head <> dependent AND relation IN ('nsubj', 'obj', 'obl', 'iobj', 'xcomp', 'ccomp')")
    if "dependent_text" in deps.columns:  # dependencies that bring their word need no join
        child = child.withColumn("word", F.lower("dependent_text"))
    else:
        child = child.join(tokens.select(*KEYS, F.col("token_idx").alias("dependent"), F.lower("text").alias("word")), [*KEYS, "dependent"])
    first = lambda rel: F.min(F.when(F.col("relation") == rel, F.struct("dependent", "word")))["word"]
    return child.groupBy(*KEYS, F.col("head").alias("token_idx")).agg(first("nsubj").alias("subject"), first("obj").alias("object"), F.array_sort(F.collect_set("word")).alias("entities"))


def _with_arguments(verbs: DataFrame, tokens: DataFrame, deps: DataFrame) -> DataFrame:
    """verbs (doc_id, sent_idx, token_idx, ...) with their arguments. Never by a broadcast: the words of all verbs would go through the driver."""
    joined = verbs.join(_arguments(tokens, deps).hint("merge"), [*KEYS, "token_idx"], "left")
    return joined.withColumn("entities", F.coalesce("entities", F.array().cast("array<string>")))


def verb_table(tokens: DataFrame, deps: DataFrame) -> DataFrame:
    """(doc_id, sent_idx, token_idx, verb, subject, object, entities): verbs with their arguments."""
    return _with_arguments(tokens.where("pos = 'VERB'").select(*KEYS, "token_idx", F.lower("text").alias("verb")), tokens, deps)


def _marker(word: Column) -> Column:
    """The longest marker that begins at a word; rows are words of sentences, all words that occur in markers among them."""
    order = W.partitionBy(*KEYS).orderBy("token_idx")
    after = lambda n: F.when(F.lead("token_idx", n).over(order) == F.col("token_idx") + n, F.lead(word, n).over(order))
    one, two, three = word, after(1), after(2)
    known = lambda words: F.when(words.isin(list(MARKERS)), words)
    return F.coalesce(known(F.concat(one, F.lit(" "), two, F.lit(" "), three)), known(F.concat(one, F.lit(" "), two)), known(one))


def _in_markers(word: Column) -> Column:
    return word.isin(sorted({w for m in MARKERS for w in m.split()}))


def marked_tokens(tokens: DataFrame) -> DataFrame:
    """(doc_id, sent_idx, token_idx, marker): places where a marker of up to three words begins; the longest counts. Only words that occur in markers are sorted."""
    rows = tokens.select(*KEYS, "token_idx", F.lower("text").alias("w")).where(_in_markers(F.col("w")))
    return rows.select(*KEYS, "token_idx", _marker(F.col("w")).alias("marker")).where("marker IS NOT NULL")


def sequences(tokens: DataFrame, deps: DataFrame, links: DataFrame, parts: int | None = None) -> DataFrame:
    """(doc_id, sent_a, a, sent_b, b, sequence_type, confidence, evidence) of all verb pairs, the earlier first, that reach 0.7.

    Three kinds of pair can reach it: verbs joined by a dependency (links), verbs of a sentence with a
    marker strictly between, and verbs two sentences apart or more with a marker in a sentence strictly
    between and a shared entity. For each verb the first marker behind it is known before it meets another, so
    the joins by sentence and by (document, entity) make only pairs that are results.
    The type is that of the dependency, or of the first marker where there is one. Where the inputs lie in `parts`
    buckets by doc_id, the verbs are put down likewise, and neither words nor pairs are shuffled.
    """
    word, is_verb = F.lower("text"), F.col("pos") == "VERB"
    rows = tokens.where(is_verb | _in_markers(word)).select(*KEYS, "token_idx", is_verb.alias("is_verb"), word.alias("w")).dropDuplicates([*KEYS, "token_idx"])
    marks = rows.withColumn("marker", _marker(F.col("w"))).where("is_verb OR marker IS NOT NULL").withColumn("m", F.when(F.col("marker").isNotNull(), F.struct("sent_idx", "token_idx", "marker")))
    # the first marker behind a verb in its sentence, and in the sentences behind it: the least of those met so far from the end
    behind = lambda w: w.rangeBetween(W.unboundedPreceding, -1)
    here = F.min("m").over(behind(W.partitionBy(*KEYS).orderBy(F.desc("token_idx"))))
    later = F.min("m").over(behind(W.partitionBy("doc_id").orderBy(F.desc("sent_idx"))))
    spots = marks.withColumn("here", here).withColumn("later", later).where("is_verb").select(*KEYS, "token_idx", "here", "later")
    # sort-merge joins: the verbs take far more memory than their files, too much for a broadcast through the driver
    found = _with_arguments(spots, tokens, deps).select("doc_id", "sent_idx", "token_idx", "entities", "here", "later")
    found = (written(found, "found") if parts is None else dealt(found, "found", "doc_id", parts)).hint("merge")
    left = found.select("doc_id", F.col("sent_idx").alias("sent_a"), F.col("token_idx").alias("a"), F.col("entities").alias("ea"), "here", "later")
    right = found.select("doc_id", F.col("sent_idx").alias("sent_b"), F.col("token_idx").alias("b"), F.col("entities").alias("eb"))
    pair, common = ["doc_id", "sent_a", "a", "sent_b", "b"], F.array_intersect("ea", "eb")
    joined = links.select("doc_id", F.col("sent_idx").alias("sent_a"), "a", F.col("sent_idx").alias("sent_b"), "b", "relation").hint("merge")
    near = left.where("here IS NOT NULL").join(right.withColumn("sent_a", F.col("sent_b")), ["doc_id", "sent_a"]).where("b > here.token_idx").select(*pair, common.alias("common"), F.col("here.marker").alias("marker"))
    near = near.join(joined, pair, "left")
    # linked verbs with a marker between are among the near ones
    linked = joined.join(left.select("doc_id", "sent_a", "a", "ea", "here"), ["doc_id", "sent_a", "a"]).where("here IS NULL OR here.token_idx >= b").join(right, ["doc_id", "sent_b", "b"]).select(*pair, common.alias("common"), F.lit(None).cast("string").alias("marker"), "relation")
    same = near.unionByName(linked)
    # two sentences apart or more: a row for each shared entity, from which the pair's entities are gathered
    first = left.where("later IS NOT NULL").select("doc_id", "sent_a", "a", F.col("later.sent_idx").alias("at"), F.col("later.marker").alias("marker"), F.explode("ea").alias("entity"))
    shared = first.join(right.select("doc_id", "sent_b", "b", F.explode("eb").alias("entity")), ["doc_id", "entity"]).where("sent_b > at")
    far = shared.groupBy(*pair).agg(F.array_sort(F.collect_set("entity")).alias("common"), F.first("marker").alias("marker"), F.lit(None).cast("string").alias("relation"))
    rows, gap = same.unionByName(far), F.col("sent_b") - F.col("sent_a")
    common, dep = F.size("common") > 0, F.col("relation").isNotNull()
    strong = dep | F.col("marker").isNotNull()
    score = F.when(dep, DEPENDENCY).otherwise(0.0) + F.when(F.col("marker").isNotNull(), MARKER).otherwise(0.0) + F.when(common, SHARED).otherwise(0.0) + F.when(gap == 0, SAME_SENTENCE).when((gap == 1) & common, ADJACENT).otherwise(0.0)
    of = lambda table: F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    kind = F.coalesce(of(MARKERS)[F.col("marker")], of(BY_DEPENDENCY)[F.col("relation")], F.lit("SEQUENTIAL"))
    evidence = F.concat_ws(";", F.concat(F.lit("direct_dependency:"), "relation"), F.concat(F.lit("marker:"), "marker"), F.when(common, F.concat(F.lit("shared_entities:"), F.array_join("common", ","))), F.when(gap == 0, "same_sentence").when((gap == 1) & common, "adjacent_with_shared_entity"))
    out = rows.where(strong | ((gap <= 1) & common)).select("doc_id", "sent_a", "a", "sent_b", "b", kind.alias("sequence_type"), F.round(F.least(F.lit(1.0), score), 6).alias("confidence"), evidence.alias("evidence"))
    return out.where(F.col("confidence") >= LEAST)


def top_chains(sequence_rows: DataFrame, most: int = 50, least: int = 2) -> DataFrame:
    """(rank, doc_id, position, sent_idx, token_idx, sequence_type, length, confidence): the `most` best chains of verbs, a row for each verb.

    A chain goes along sequences from a verb that none leads to, to one that leads nowhere, over `least` sequences or
    more. The best are the longest, then those of highest mean confidence; ties by document and then by the places of the verbs from
    the end. sequence_type is that of the step to the next verb. Chains don't leave a document, so each document is
    one group: its verbs are taken in order of the text, and each keeps its `most` best chains as pointers to those of the
    verbs before it. The documents' best meet in a bounded top list.
    """

    def best(key: tuple, rows: pa.Table) -> pa.Table:
        into: dict[tuple, list[tuple]] = {}
        ends, kinds = set(), {}
        for sa, a, sb, b, kind, c in zip(*(rows.column(k).to_pylist() for k in ("sent_a", "a", "sent_b", "b", "sequence_type", "confidence"))):
            u, v = (sa, a), (sb, b)
            if u < v and (u, v) not in kinds:
                into.setdefault(v, []).append((u, round((c or 0.0) * 1_000_000)))
                kinds[u, v] = kind
                ends.add(u)
        kept: dict[tuple, list[tuple]] = {v: [(0, 0, None, 0)] for v in ends if v not in into}
        for v in sorted(into):
            found = ((n + 1, s + c, u, k) for u, c in into[v] for k, (n, s, _, _) in enumerate(kept[u]))
            kept[v] = heapq.nsmallest(most, found, key=lambda x: (-x[0], -x[1], x[2], x[3]))
        last = heapq.nsmallest(most, ((-n, -s, v, k) for v in into if v not in ends for k, (n, s, _, _) in enumerate(kept[v]) if n >= least))
        out: dict[str, list] = {k: [] for k in ("doc_id", "place", "length", "sum", "steps")}
        for place, (n, s, v, k) in enumerate(last):
            steps, onward = [], None
            while v is not None:
                steps.append({"sent_idx": v[0], "token_idx": v[1], "sequence_type": kinds.get((v, onward))})
                onward, (_, _, v, k) = v, kept[v][k]
            for name, value in zip(out, (key[0].as_py(), place, -n, -s, steps[::-1])):
                out[name].append(value)
        step = pa.list_(pa.struct([("sent_idx", pa.int64()), ("token_idx", pa.int64()), ("sequence_type", pa.string())]))
        return pa.table([pa.array(out[k], t) for k, t in zip(out, (key[0].type, pa.int64(), pa.int64(), pa.int64(), step))], names=list(out))

    kind = sequence_rows.schema["doc_id"].dataType.simpleString()
    rows = sequence_rows.select("doc_id", "sent_a", "a", "sent_b", "b", "sequence_type", "confidence")
    found = rows.groupBy("doc_id").applyInArrow(best, f"doc_id {kind}, place long, length long, sum long, steps array<struct<sent_idx:long,token_idx:long,sequence_type:string>>")
    mean = F.col("sum") / F.col("length")
    order = [F.desc("length"), F.desc("sum"), F.asc("doc_id"), F.asc("place")]
    top = found.orderBy(*order).limit(most).withColumn("rank", F.row_number().over(W.orderBy(*order)))  # a bounded number of rows
    return top.select("rank", "doc_id", "length", F.round(mean / 1_000_000, 6).alias("confidence"), F.posexplode("steps").alias("position", "x")).select("rank", "doc_id", "position", "x.sent_idx", "x.token_idx", "x.sequence_type", "length", "confidence")


def page(sequence_rows: DataFrame, skip: int, limit: int) -> DataFrame:
    """Sequences by descending confidence, ties by place."""
    return sequence_rows.orderBy(F.desc("confidence"), "doc_id", "sent_a", "a", "sent_b", "b").offset(skip).limit(limit)


def exported(sequence_rows: DataFrame, verbs: DataFrame) -> DataFrame:
    """(doc_id, verb1, verb2, subject, object, sequence_type, confidence, evidence) for export: the subject of the first verb, the object of the second."""
    first = verbs.select("doc_id", F.col("sent_idx").alias("sent_a"), F.col("token_idx").alias("a"), F.col("verb").alias("verb1"), "subject")
    second = verbs.select("doc_id", F.col("sent_idx").alias("sent_b"), F.col("token_idx").alias("b"), F.col("verb").alias("verb2"), "object")
    return sequence_rows.join(first, ["doc_id", "sent_a", "a"]).join(second, ["doc_id", "sent_b", "b"]).select("doc_id", "verb1", "verb2", "subject", "object", "sequence_type", "confidence", "evidence").distinct()


def cleared(sequence_rows: DataFrame) -> DataFrame:
    """No sequences, with the same columns."""
    return sequence_rows.where(F.lit(False))


def sequence_statistics(sequences: DataFrame) -> DataFrame:
    return sequences.groupBy("sequence_type").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def entity_stars(verbs: DataFrame) -> DataFrame:
    """(doc_id, entity, first, member): verbs of a document that share an entity, linked to the first of them; a star for each entity instead of all pairs."""
    place = F.struct("sent_idx", "token_idx")
    rows = verbs.select("doc_id", "sent_idx", "token_idx", F.explode("entities").alias("entity")).where("entity <> ''")
    first = rows.withColumn("f", F.min(place).over(W.partitionBy("doc_id", "entity")))
    return first.where(place != F.col("f")).select("doc_id", "entity", F.concat_ws(".", "f.sent_idx", "f.token_idx").alias("first"), F.concat_ws(".", "sent_idx", "token_idx").alias("member"))


def nearest_actions(actions: DataFrame, hits: DataFrame, tolerance: int = 500) -> DataFrame:
    """(doc_id, at, before, after): for each marker hit the nearest action before and after it within the tolerance; two sorts by document."""
    a = actions.select("doc_id", F.col("pos").alias("at"), F.lit(0).alias("kind"), F.struct("pos", "id").alias("x"))
    b = hits.select("doc_id", "at", F.lit(1).alias("kind"), F.lit(None).cast("struct<pos:int,id:string>").alias("x"))
    back = F.last("x", True).over(W.partitionBy("doc_id").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, 0))
    # from the end: a frame that reaches to the end would be gone through again for each row
    ahead = F.last("x", True).over(W.partitionBy("doc_id").orderBy(F.desc("at"), F.desc("kind")).rowsBetween(W.unboundedPreceding, 0))
    both = a.unionByName(b).withColumn("p", back).withColumn("q", ahead).where("kind = 1")
    near = lambda c: F.when(F.abs(F.col(f"{c}.pos") - F.col("at")) <= tolerance, F.col(f"{c}.id"))
    return both.select("doc_id", "at", near("p").alias("before"), near("q").alias("after"))


def resolve_conflicts(deps: DataFrame, priority: dict[str, int]) -> DataFrame:
    """One dependency for each (src, dst): the highest priority, then confidence, then relation; markers of all are united."""
    p = F.coalesce(F.create_map(*[F.lit(x) for kv in priority.items() for x in kv])[F.col("relation")], F.lit(0))
    best = deps.withColumn("p", p).groupBy("src", "dst").agg(F.max(F.struct("p", "confidence", "relation")).alias("m"), F.array_sort(F.collect_set("marker")).alias("markers"))
    return best.select("src", "dst", F.col("m.relation").alias("relation"), F.col("m.confidence").alias("confidence"), F.array_join("markers", ",").alias("markers"))


def upsert_sequences(old: DataFrame, new: DataFrame) -> DataFrame:
    """(a, b, confidence, change): created, updated or kept by pair."""
    joined = old.select("a", "b", F.col("confidence").alias("_o")).join(new.select("a", "b", F.col("confidence").alias("_n")), ["a", "b"], "full")
    change = F.when(F.col("_o").isNull(), "created").when(F.col("_n").isNotNull(), "updated").otherwise("kept")
    return joined.select("a", "b", F.coalesce("_n", "_o").alias("confidence"), change.alias("change"))


def success_patterns(edges: DataFrame, goal_rows: DataFrame, cutoff: int = 10) -> DataFrame:
    """(goal, size, depth, width, causal, score) of the ancestors of each goal in an acyclic graph, largest score first.

    Depth: edges of the longest path to the goal, `cutoff` at most, by one pass over the layers of paths and
    not over the paths. Width: the most vertices at one distance. causal: CAUSES and ENABLES edges among
    the ancestors. score = size + 2 * depth + 3 * causal.
    """
    from inkgraph.operators.graph import ancestors
    from inkgraph.plans.scratch import written

    reach = written(ancestors(edges, goal_rows.select(F.col("id").alias("v"))), "reach")
    per_hop = reach.groupBy("start", "hops").agg(F.count("*").alias("n"))
    shape = per_hop.groupBy("start").agg(F.sum("n").alias("size"), F.max("n").alias("width"))
    front = goal_rows.select(F.col("id").alias("start"), F.col("id").alias("v")).distinct()
    depth = front.select("start", F.lit(0).alias("d"))
    for k in range(1, cutoff + 1):  # which vertices a path of k edges leads from
        front = written(front.join(edges.select(F.col("dst").alias("v"), "src"), "v").select("start", F.col("src").alias("v")).distinct(), "front")
        if front.isEmpty():
            break
        depth = depth.unionByName(front.select("start", F.lit(k).alias("d")).distinct())
    depth = depth.groupBy("start").agg(F.max("d").alias("depth"))
    inside = edges.where("relation IN ('CAUSES', 'ENABLES')").select("src", "dst").join(reach.select("start", F.col("v").alias("src")), "src").join(reach.select("start", F.col("v").alias("dst")), ["start", "dst"])
    causal = inside.groupBy("start").agg(F.count("*").alias("causal"))
    out = shape.join(depth, "start").join(causal, "start", "left").na.fill(0, ["causal"])
    return out.select(F.col("start").alias("goal"), "size", "depth", "width", "causal", (F.col("size") + 2 * F.col("depth") + 3 * F.col("causal")).alias("score")).orderBy(F.desc("score"), "goal")


def causal_listing(edges: DataFrame, actions: DataFrame) -> DataFrame:
    """(relation, source_text, target_text) of causal edges."""
    a, b = actions.select(F.col("id").alias("src"), F.col("object").alias("source_text")), actions.select(F.col("id").alias("dst"), F.col("object").alias("target_text"))
    return edges.where("relation IN ('CAUSES', 'PREVENTS', 'ENABLES')").join(a, "src").join(b, "dst").select("relation", "source_text", "target_text")
