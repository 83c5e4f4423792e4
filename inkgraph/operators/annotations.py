"""Stand-off annotations: checks, lists, updates, offset shifts after edits, validation. Rows: uid, doc_id, annotation_type, start, end, text, source, confidence."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window as W

from inkgraph.operators import text as text_ops
from inkgraph.plans.scratch import written


def checked(annotations: DataFrame) -> DataFrame:
    """With error: start below 0, or end not behind start; null where both hold."""
    error = F.when(F.col("start").isNull() | F.col("end").isNull(), "offset missing").when(F.col("start") < 0, "start below 0").when(F.col("end") <= F.col("start"), "end not behind start")
    return annotations.withColumn("error", error)


def _selected(annotations: DataFrame, types: list[str], sources: list[str]) -> DataFrame:
    out = annotations
    if types:
        out = out.where(F.col("annotation_type").isin(types))
    if sources:
        out = out.where(F.col("source").isin(sources))
    return out


def listed(annotations: DataFrame, types: list[str], sources: list[str], skip: int, limit: int) -> DataFrame:
    """A page in order of start, filtered by type and source where lists are given."""
    return _selected(annotations, types, sources).orderBy("doc_id", "start", "uid").offset(skip).limit(limit)


def page_facts(annotations: DataFrame, types: list[str], sources: list[str], skip: int, limit: int) -> DataFrame:
    """One row of such a page: total of the filter, rows returned, and whether more follow."""
    total = F.count("*")
    returned = F.least(F.greatest(total - skip, F.lit(0)), F.lit(limit))
    return _selected(annotations, types, sources).agg(total.alias("total"), returned.alias("returned"), (total > skip + limit).alias("has_more"))


def updated(annotations: DataFrame, changes: DataFrame) -> DataFrame:
    """Values of changes replace those of equal uid, null leaves them; offsets are checked again."""
    names = [c for c in changes.columns if c != "uid"]
    new = changes.select("uid", *(F.col(c).alias(f"_{c}") for c in names))
    out = annotations.join(new, "uid", "left").select("uid", *(F.coalesce(f"_{c}", c).alias(c) if c in names else F.col(c) for c in annotations.columns if c != "uid"))
    return checked(out)


def deleted(annotations: DataFrame, gone: DataFrame) -> DataFrame:
    return annotations.join(gone.select("uid"), "uid", "left_anti")


def relations_created(relations: DataFrame, annotations: DataFrame) -> DataFrame:
    """Relations with both ends known and different; RELATED where the type is missing."""
    known = annotations.select("uid")
    ends = relations.join(known.withColumnRenamed("uid", "source_uid"), "source_uid", "left_semi").join(known.withColumnRenamed("uid", "target_uid"), "target_uid", "left_semi")
    return ends.where("source_uid <> target_uid").select("source_uid", "target_uid", F.coalesce("relation_type", F.lit("RELATED")).alias("relation_type"))


def relations_of(relations: DataFrame) -> DataFrame:
    """(uid, other, relation_type, direction): each relation seen from both ends."""
    out = relations.select(F.col("source_uid").alias("uid"), F.col("target_uid").alias("other"), "relation_type", F.lit("outgoing").alias("direction"))
    return out.unionByName(relations.select(F.col("target_uid").alias("uid"), F.col("source_uid").alias("other"), "relation_type", F.lit("incoming").alias("direction")))


def edit_range(old: Column, new: Column) -> Column:
    """struct(start, old_end, new_end): what lies between the common prefix and the common suffix of two texts.

    The lengths are found by halving, so texts are compared some 20 times and not character by character.
    """

    def common(a: Column, b: Column, limit: Column) -> Column:
        def step(n: Column, power: Column) -> Column:
            more = n + power
            return F.when((more <= limit) & (F.substring(a, F.lit(1), more) == F.substring(b, F.lit(1), more)), more).otherwise(n)

        return F.aggregate(F.array(*(F.lit(1 << k) for k in range(26, -1, -1))), F.lit(0), step)

    # each length is found once and then named, since a step that holds another length's steps would take them again
    named = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    texts = F.struct(old.alias("a"), new.alias("b"), F.reverse(old).alias("c"), F.reverse(new).alias("d"), F.length(old).alias("m"), F.length(new).alias("n"))
    prefixed = named(texts, lambda t: F.struct(*(t[k].alias(k) for k in "cdmn"), common(t["a"], t["b"], F.least(t["m"], t["n"])).alias("p")))
    sized = named(prefixed, lambda t: F.struct(*(t[k].alias(k) for k in "mnp"), common(t["c"], t["d"], F.least(t["m"], t["n"]) - t["p"]).alias("s")))
    return named(sized, lambda t: F.struct(t["p"].alias("start"), (t["m"] - t["s"]).alias("old_end"), (t["n"] - t["s"]).alias("new_end")))


def _after(span: Column, e: Column) -> Column:
    """A span after one edit; a span without length stays as it is."""
    s, t, a, b, n = span["s"], span["t"], e["from"], e["to"], e["length"]
    delta = n - (b - a)
    inside = (s >= a) & (t <= b) & (b > a)
    scaled = lambda x: (a + F.floor((x - a) * n / (b - a))).cast("long")
    start = F.when(t <= a, s).when(s >= b, s + delta).when((s <= a) & (t >= b), s).when(inside, scaled(s)).when(s < a, s).otherwise(a + n)
    end = F.when(t <= a, t).when(s >= b, t + delta).when((s <= a) & (t >= b), t + delta).when(inside, scaled(t)).when(s < a, a).otherwise(t + delta)
    gone = t <= s
    return F.struct(F.when(gone, s).otherwise(start).cast("long").alias("s"), F.when(gone, t).otherwise(end).cast("long").alias("t"))


def shifted(annotations: DataFrame, edits: DataFrame) -> DataFrame:
    """Annotations after the edits of their document, each of which replaces [from, to) by `length` characters.

    Before an edit: unchanged. Behind it: moved. Around it: the end moves. Cut on the left or right:
    the part outside stays. Inside: scaled. What has no length left is deleted. With a column seq the edits follow
    each other and each means the text as the one before left it; without it all mean the text as it was, and
    are taken from the last position to the first, so that none moves another. Edits with a null are left out.
    """
    known = edits.where("from IS NOT NULL AND to IS NOT NULL AND length IS NOT NULL")
    place = F.col("seq").cast("long") if "seq" in edits.columns else -F.col("from").cast("long")
    one = F.struct(place.alias("k"), (-F.col("to")).cast("long").alias("l"), F.col("from").cast("long").alias("from"), F.col("to").cast("long").alias("to"), F.col("length").cast("long").alias("length"))
    per = known.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("_edits"))
    span = F.struct(F.col("start").cast("long").alias("s"), F.col("end").cast("long").alias("t"))
    out = annotations.join(per, "doc_id", "left").withColumn("_p", F.when(F.col("_edits").isNull(), span).otherwise(F.aggregate("_edits", span, _after)))
    kept = [c for c in annotations.columns if c not in ("start", "end")]
    return out.where("_p.t > _p.s").select(*kept, F.col("_p.s").alias("start"), F.col("_p.t").alias("end"))


def text_changed(annotations: DataFrame, texts: DataFrame) -> DataFrame:
    """Annotations whose text is not what stands at their offsets."""
    joined = annotations.join(texts.select("doc_id", F.col("text").alias("_text")), "doc_id")
    return joined.where(F.substring("_text", F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int")) != F.col("text")).select("uid")


def validation_issues(annotations: DataFrame, texts: DataFrame) -> DataFrame:
    """(uid, severity, rule) of every rule that an annotation breaks; offsets may be of any number type, a column color is looked at where there is one."""
    repeated = annotations.groupBy("uid").agg(F.count("*").alias("_n")).where("_n > 1")
    # texts meet the annotations last, so that no text goes through another shuffle
    joined = annotations.join(repeated, "uid", "left").join(texts.select("doc_id", F.col("text").alias("_text")), "doc_id", "left")
    off = F.coalesce((F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.length("_text")), F.lit(False))
    rules = [
        ("error", "required field", F.col("annotation_type").isNull() | F.col("text").isNull()),
        ("error", "offsets", ~off),
        ("warning", "text differs", off & (F.substring("_text", F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int")) != F.col("text"))),
        ("error", "confidence", F.col("confidence").isNotNull() & ~F.col("confidence").between(0, 1)),
        ("error", "uid not unique", F.col("_n") > 1),
    ]
    broken = [F.col(c) != F.floor(c) for c in ("start", "end") if not isinstance(annotations.schema[c].dataType, IntegralType)]
    if broken:
        rules.append(("error", "offsets not integer", reduce(lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)), broken, F.lit(False))))
    if "color" in annotations.columns:
        rules.append(("warning", "color", ~(F.startswith("color", F.lit("#")) & (F.length("color") == 7))))
    found = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(s).alias("severity"), F.lit(r).alias("rule"))) for s, r, bad in rules)))
    return joined.select("uid", F.explode(found).alias("x")).select("uid", "x.*")


def verdict(issues: DataFrame, annotations: DataFrame) -> DataFrame:
    """(doc_id, verdict): failed, valid with warnings, or valid."""
    per = annotations.select("uid", "doc_id").join(issues, "uid", "left").groupBy("doc_id").agg(F.count(F.when(F.col("severity") == "error", 1)).alias("e"), F.count(F.when(F.col("severity") == "warning", 1)).alias("w"))
    return per.select("doc_id", F.when(F.col("e") > 0, "failed").when(F.col("w") > 0, "valid with warnings").otherwise("valid").alias("verdict"))


def overlapping_types(annotations: DataFrame, selections: DataFrame, most: int = 10) -> DataFrame:
    """(sel_id, annotation_type, confidence): the best of each type that overlaps a selection."""
    s = selections.select("sel_id", "doc_id", F.col("start").alias("a"), F.col("end").alias("b"))
    hits = annotations.join(s, "doc_id").where("start < b AND end > a").groupBy("sel_id", "annotation_type").agg(F.max("confidence").alias("confidence"))
    return hits.withColumn("r", F.row_number().over(W.partitionBy("sel_id").orderBy(F.desc("confidence"), "annotation_type"))).where(F.col("r") <= most).drop("r")


def patterns(annotations: DataFrame, source: str) -> DataFrame:
    """(pattern_id, source_token_uid, doc_id, text, annotation_type, confidence) of one source's annotations."""
    return annotations.where(F.col("source") == source).select(F.md5(F.concat_ws(":", "doc_id", "uid")).alias("pattern_id"), F.col("uid").alias("source_token_uid"), "doc_id", "text", "annotation_type", "confidence")


def pattern_properties(rows: DataFrame) -> DataFrame:
    """(pattern_id, type, value): text, annotation type and confidence, absent where empty."""
    pairs = F.array(*(F.struct(F.lit(c).alias("type"), F.col(c).cast("string").alias("value")) for c in ("text", "annotation_type", "confidence")))
    return rows.select("pattern_id", F.explode(pairs).alias("p")).select("pattern_id", "p.*").where("value IS NOT NULL AND value <> ''")


def pivoted(properties: DataFrame) -> DataFrame:
    """One row for each pattern, a column for each type."""
    return properties.groupBy("pattern_id").pivot("type", ["text", "annotation_type", "confidence"]).agg(F.max("value"))


def updates_reported(annotations: DataFrame, changes: DataFrame) -> DataFrame:
    """(uid, error) of every row of an offset change table (uid, start, end): unknown uid, a broken offset rule, or null where it holds."""
    known = annotations.select("uid", F.lit(True).alias("_known"))
    joined = changes.join(known, "uid", "left")
    return joined.select("uid", F.when(F.col("_known").isNull(), "unknown annotation").when(F.col("start") < 0, "start below 0").when(F.col("end") <= F.col("start"), "end not behind start").alias("error"))


def of_categories(annotations: DataFrame, types: DataFrame, categories: list[str]) -> DataFrame:
    """Annotations whose type belongs to one of the categories; types: category, annotation_type."""
    return annotations.join(F.broadcast(types.where(F.col("category").isin(categories)).select("annotation_type").distinct()), "annotation_type", "left_semi")


def from_tokens(tokens: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, category, annotation_type, start, end, text, confidence): a part-of-speech row and, for each feature of its morph map, a morphology row of every token sure enough."""
    sure = tokens.where(F.col("confidence") >= least)
    pos = sure.select("doc_id", F.lit("pos").alias("category"), F.col("pos").alias("annotation_type"), "start", "end", "text", "confidence")
    morph = sure.select("doc_id", "start", "end", "text", "confidence", F.explode("morph").alias("feature", "value"))
    return pos.unionByName(morph.select("doc_id", F.lit("morphology").alias("category"), F.concat_ws("=", "feature", "value").alias("annotation_type"), "start", "end", "text", "confidence"))


def for_selections(tokens: DataFrame, entities: DataFrame, selections: DataFrame) -> DataFrame:
    """(sel_id, token, entity): the first token and the first entity that begin in a selection [start, end) of their document."""
    s = selections.select("sel_id", "doc_id", F.col("start").alias("a"), F.col("end").alias("b"))

    def first(rows: DataFrame, name: str) -> DataFrame:
        inside = rows.select("doc_id", "start", "text").join(s, "doc_id").where("start >= a AND start < b")
        return inside.groupBy("sel_id").agg(F.min_by("text", F.struct("start", "text")).alias(name))

    return s.select("sel_id").join(first(tokens, "token"), "sel_id", "left").join(first(entities, "entity"), "sel_id", "left")


def from_votes(voted: DataFrame, documents: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, start, end, text, annotation_type, confidence) of agreed tokens that are sure enough, no white space, and stand in the text at their offsets."""
    sure = voted.where(F.col("agreed") & (F.col("confidence") >= least) & (F.trim("text") != ""))
    if "stands" in voted.columns:  # votes that bring whether they stand in their text need no join
        return sure.where("stands AND doc_id IS NOT NULL").select("doc_id", "start", "end", "text", F.col("pos").alias("annotation_type"), "confidence")
    rows = sure.select("doc_id", "start", "end", F.col("text").alias("word"), F.col("pos").alias("annotation_type"), "confidence")
    joined = rows.join(documents.select("doc_id", "text"), "doc_id")
    there = F.substring("text", F.col("start").cast("int") + 1, F.length("word")) == F.col("word")
    return joined.where(there).select("doc_id", "start", "end", F.col("word").alias("text"), "annotation_type", "confidence")


def relations_from_dependencies(deps: DataFrame, annotated: DataFrame, least: float = 0.5) -> DataFrame:
    """(source_uid, target_uid, relation_type) from dependent to head where both tokens are annotated; annotated: doc_id, sent_idx, token_idx, uid."""
    keys = ["doc_id", "sent_idx"]
    sure = deps.where((F.col("confidence") >= least) & (F.col("head") != F.col("dependent")))
    a = annotated.select(*keys, F.col("token_idx").alias("dependent"), F.col("uid").alias("source_uid"))
    b = annotated.select(*keys, F.col("token_idx").alias("head"), F.col("uid").alias("target_uid"))
    return sure.join(a, [*keys, "dependent"]).join(b, [*keys, "head"]).select("source_uid", "target_uid", F.col("relation").alias("relation_type"))


def display_graph(tokens: DataFrame, deps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, label, kind; edges: source, target, label) of content words and the dependencies between them."""
    key = F.concat_ws(".", "doc_id", "sent_idx", "token_idx")
    content = ("NOUN", "VERB", "ADJ", "ADV")
    nodes = tokens.where(F.col("pos").isin(*content)).select("doc_id", "sent_idx", "token_idx", key.alias("id"), F.col("text").alias("label"), F.lower("pos").alias("kind"))
    if {"dependent_pos", "head_pos"} <= set(deps.columns):  # dependencies that bring these need no join
        own = deps.where(F.col("dependent_pos").isin(*content) & F.col("head_pos").isin(*content) & (F.col("head") != F.col("dependent")))
        return nodes.select("id", "label", "kind"), own.select(F.concat_ws(".", "doc_id", "sent_idx", "dependent").alias("source"), F.concat_ws(".", "doc_id", "sent_idx", "head").alias("target"), F.col("relation").alias("label"))
    ends = nodes.select("doc_id", "sent_idx", "token_idx", "id")
    edges = deps.where("head <> dependent").join(ends.withColumnsRenamed({"token_idx": "head", "id": "target"}), ["doc_id", "sent_idx", "head"]).join(ends.withColumnsRenamed({"token_idx": "dependent", "id": "source"}), ["doc_id", "sent_idx", "dependent"])
    return nodes.select("id", "label", "kind"), edges.select("source", "target", F.col("relation").alias("label"))


def property_graph(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, kind; edges: source, target, kind): documents hold sentences, sentences hold tokens, a token is followed by the next of its sentence."""
    doc, sent = F.col("doc_id").cast("string"), F.concat_ws(".", "doc_id", "sent_idx")
    token = F.concat_ws(".", "doc_id", "sent_idx", "token_idx")
    # places are dealt once by sentence and made unique as numbers; ids are made last and never compared
    places = tokens.select("doc_id", "sent_idx", "token_idx").repartition("doc_id", "sent_idx").distinct()
    sentences = tokens.select("doc_id", "sent_idx").distinct()
    nodes = tokens.select(doc.alias("id")).distinct().select("id", F.lit("document").alias("kind")).unionByName(sentences.select(sent.alias("id"), F.lit("sentence").alias("kind"))).unionByName(places.select(token.alias("id"), F.lit("token").alias("kind")))
    order = W.partitionBy("doc_id", "sent_idx").orderBy("token_idx")
    rows = places.withColumn("_next", F.lead(F.struct("doc_id", "sent_idx", "token_idx")).over(order)).withColumn("_first", F.row_number().over(order) == 1)
    follow = F.concat_ws(".", "_next.doc_id", "_next.sent_idx", "_next.token_idx")
    made = F.array(F.when(F.col("_first"), F.struct(doc.alias("source"), sent.alias("target"), F.lit("HAS_SENTENCE").alias("kind"))), F.struct(sent.alias("source"), token.alias("target"), F.lit("HAS_TOKEN").alias("kind")), F.when(F.col("_next").isNotNull(), F.struct(token.alias("source"), follow.alias("target"), F.lit("NEXT").alias("kind"))))
    edges = rows.select(F.explode(made).alias("e")).where("e IS NOT NULL").select("e.*")
    return nodes, edges


def linguistic_relations(relations: DataFrame, pattern_rows: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """(source_pattern, target_pattern, relation_type): relations of annotations lifted to the patterns made from them.

    within: columns of both tables, such as doc_id, that a relation has in common with both its ends. Tables that lie in buckets by one of them are joined as they lie.
    """
    a = pattern_rows.select(*within, F.col("source_token_uid").alias("source_uid"), F.col("pattern_id").alias("source_pattern"))
    b = pattern_rows.select(*within, F.col("source_token_uid").alias("target_uid"), F.col("pattern_id").alias("target_pattern"))
    return relations.join(a, [*within, "source_uid"]).join(b, [*within, "target_uid"]).select("source_pattern", "target_pattern", "relation_type")


def relation_issues(relations: DataFrame, annotations: DataFrame) -> DataFrame:
    """(source_uid, target_uid, severity, rule): a missing end or type, an end that is no annotation; a self loop is a warning."""
    known = annotations.select("uid").distinct()
    joined = relations.join(known.select(F.col("uid").alias("source_uid"), F.lit(True).alias("_s")), "source_uid", "left").join(known.select(F.col("uid").alias("target_uid"), F.lit(True).alias("_t")), "target_uid", "left")
    rules = [("error", "required field", F.col("source_uid").isNull() | F.col("target_uid").isNull() | F.col("relation_type").isNull()), ("error", "source unknown", F.col("source_uid").isNotNull() & F.col("_s").isNull()), ("error", "target unknown", F.col("target_uid").isNotNull() & F.col("_t").isNull()), ("warning", "self loop", F.col("source_uid") == F.col("target_uid"))]
    found = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(s).alias("severity"), F.lit(r).alias("rule"))) for s, r, bad in rules)))
    return joined.select("source_uid", "target_uid", F.explode(found).alias("x")).select("source_uid", "target_uid", "x.*")


def chain_issues(chains: DataFrame, types: list[str]) -> DataFrame:
    """(chain_id, severity, rule) of chains (chain_id, sequence_type, verbs, confidence): the type is none of the allowed, fewer than two verbs (a warning), confidence outside 0 to 1."""
    rules = [("error", "sequence type", ~F.coalesce(F.col("sequence_type").isin(types), F.lit(False))), ("warning", "fewer than two verbs", F.coalesce(F.size("verbs"), F.lit(0)) < 2), ("error", "confidence", F.col("confidence").isNotNull() & ~F.col("confidence").between(0, 1))]
    found = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(s).alias("severity"), F.lit(r).alias("rule"))) for s, r, bad in rules)))
    return chains.select("chain_id", F.explode(found).alias("x")).select("chain_id", "x.*")


def missing_parts(present: DataFrame, required: DataFrame) -> DataFrame:
    """(sample_id, part): required parts (part) that a sample of (sample_id, part) rows lacks."""
    wanted = present.select("sample_id").distinct().crossJoin(F.broadcast(required.select("part").distinct()))  # a fixed handful of parts
    return wanted.join(present.select("sample_id", "part"), ["sample_id", "part"], "left_anti")


def compared_with_golden(run: DataFrame, golden: DataFrame, near: float = 0.05, least: float = 0.6) -> DataFrame:
    """(doc_id, golden, found, coverage, passes): how many golden annotations a run has with the same span, type and text and a confidence within `near`."""
    keys = ["doc_id", "start", "end", "annotation_type", "text"]
    hits = golden.select(*keys, F.col("confidence").alias("g")).join(run.select(*keys, F.col("confidence").alias("r")), keys, "left").withColumn("hit", F.coalesce(F.abs(F.col("g") - F.col("r")) <= near + 1e-9, F.lit(False)))
    one = hits.groupBy(*keys).agg(F.max("hit").alias("hit"))
    per = one.groupBy("doc_id").agg(F.count("*").alias("golden"), F.count(F.when(F.col("hit"), 1)).alias("found"))
    share = F.col("found") / F.col("golden")
    return per.select("doc_id", "golden", "found", F.round(share, 6).alias("coverage"), (share >= least).alias("passes"))


def auto_annotated(documents: DataFrame, annotate: Callable[[DataFrame], tuple[DataFrame, DataFrame]], types: list[str] | None = None, least: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """(annotations, relations) that an annotator finds in the Markdown-filtered texts, at their places in the texts as they are.

    annotate takes (doc_id, text) and returns spans (doc_id, start, end, text, annotation_type, confidence) and
    links (doc_id, source_start, source_end, target_start, target_end, relation_type). Spans below `least`, without a confidence or of
    other types than given are left out. An end is found by the last character of a span. The uid is made
    of document, place and type, so equal spans of one type are one annotation, with the highest confidence. A link joins the annotations with its spans, of several types that with the last in
    order of names; links with an end that is no annotation are left out. Documents whose filtered text is blank have none.
    """
    pieces = written(text_ops.markdown_pieces(documents), "pieces")
    filtered = text_ops.joined_pieces(documents, pieces).where("trim(text) <> ''")
    spans, links = annotate(filtered)
    sure = spans.where((F.col("confidence") >= least) & (F.col("end") > F.col("start")))
    if types is not None:
        sure = sure.where(F.col("annotation_type").isin(types))
    one = sure.groupBy("doc_id", "start", "end", "annotation_type").agg(F.max("confidence").alias("confidence"), F.max("text").alias("text"))
    places = text_ops.spans_to_original(one.select("doc_id", "start", "end").distinct(), pieces)
    placed = one.join(places, ["doc_id", "start", "end"])
    found = written(placed.select(F.concat_ws("-", "doc_id", "original_start", "original_end", "annotation_type").alias("uid"), "doc_id", "annotation_type", "start", "end", "original_start", "original_end", "text", "confidence"), "found")
    ends = found.groupBy("doc_id", "start", "end").agg(F.max_by("uid", "annotation_type").alias("uid"))
    joined = links.join(ends.toDF("doc_id", "source_start", "source_end", "source_uid"), ["doc_id", "source_start", "source_end"]).join(ends.toDF("doc_id", "target_start", "target_end", "target_uid"), ["doc_id", "target_start", "target_end"])
    annotations = found.select("uid", "doc_id", "annotation_type", F.col("original_start").alias("start"), F.col("original_end").alias("end"), "text", F.lit("auto").alias("source"), "confidence")
    return annotations, joined.select("source_uid", "target_uid", "relation_type").distinct()
