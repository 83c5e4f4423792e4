"""Tokens of several rule tokenizers, their tags and flags, and counts over them. Rows: doc_id, processor, idx, text, start, end, pos, confidence."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from inkgraph.operators.running import running_sums

#: Token patterns by processor, in order.
PATTERNS = {"space": r"\S+", "word": r"[\p{L}\p{N}]+", "mark": r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"}
#: Universal part-of-speech tags, open and closed classes.
OPEN_CLASS = ["ADJ", "ADV", "INTJ", "NOUN", "PROPN", "VERB"]
CLOSED_CLASS = ["ADP", "AUX", "CCONJ", "DET", "NUM", "PART", "PRON", "SCONJ"]
OTHER_CLASS = ["PUNCT", "SYM", "X"]
CONTENT = ["NOUN", "VERB", "ADJ", "ADV"]
#: Treebank tags and their universal tags, as far as the rule tagger uses them.
UNIVERSAL = {"NN": "NOUN", "NNS": "NOUN", "NNP": "PROPN", "VB": "VERB", "VBG": "VERB", "VBD": "VERB", "JJ": "ADJ", "RB": "ADV", "DT": "DET", "IN": "ADP", "CC": "CCONJ", "CD": "NUM", ".": "PUNCT"}
#: Confidence of a token by processor.
SURE = {"space": 0.7, "word": 0.8, "mark": 0.9}
STOP_WORDS = ["the", "and", "of", "to", "in", "a", "is", "that", "for", "it", "with", "as", "was", "on", "be", "by", "this", "are", "or", "an", "from", "at"]


#: Fixed values of the rule tagger: tags of closed classes and of endings, the first that fits.
_CLOSED = dict.fromkeys(["the", "a", "an", "this", "that"], "DT") | dict.fromkeys(["and", "or"], "CC") | dict.fromkeys(["of", "to", "in", "for", "with", "on", "by", "from", "at", "as"], "IN")
_ENDINGS = [("ing", "VBG"), ("ed", "VBD"), ("ly", "RB"), ("ble", "JJ"), ("es", "NNS")]
_ANY_ENDING = tuple(ending for ending, _ in _ENDINGS)


def guessed_tag(text: Column, low: Column | None = None) -> Column:
    """A treebank tag from the form alone; low is the lower-cased form, where it is there already."""
    low = F.lower(text) if low is None else low
    return (
        F.when(~text.rlike(r"[\p{L}\p{N}]"), ".")
        .when(text.rlike(r"^\p{N}+$"), "CD")
        .when(low.isin("the", "a", "an", "this", "that"), "DT")
        .when(low.isin("and", "or"), "CC")
        .when(low.isin("of", "to", "in", "for", "with", "on", "by", "from", "at", "as"), "IN")
        .when(F.endswith(low, F.lit("ing")), "VBG")
        .when(F.endswith(low, F.lit("ed")), "VBD")
        .when(F.endswith(low, F.lit("ly")), "RB")
        .when(F.endswith(low, F.lit("ble")), "JJ")
        .when(F.endswith(low, F.lit("es")), "NNS")
        .otherwise("NN")
    )


def tokenize(documents: DataFrame, processors: dict[str, str] = PATTERNS) -> DataFrame:
    """Tokens of each processor with code-point offsets: the gaps between tokens and the tokens' lengths are summed up inside a text, so no token is shuffled or sorted."""
    frames = None
    for name, pattern in processors.items():
        found = F.regexp_extract_all("text", F.lit(f"({pattern})"), F.lit(1))
        gaps = F.split("text", pattern, -1)
        cut = documents.select("doc_id", found.alias("t"), F.transform(F.arrays_zip(found.alias("t"), F.slice(gaps, 1, F.size(found)).alias("g")), lambda x: F.length(x["g"]) + F.length(x["t"])).alias("n"))
        rows = cut.select("doc_id", F.posexplode(F.arrays_zip("t", running_sums("n").alias("end"))).alias("idx", "x"))
        part = rows.select("doc_id", F.lit(name).alias("processor"), "idx", F.col("x.t").alias("text"), (F.col("x.end") - F.length("x.t")).alias("start"), F.col("x.end").alias("end"))
        frames = part if frames is None else frames.unionByName(part)
    return frames


def offsets_hold(tokens: DataFrame, documents: DataFrame, stretch: int = 64) -> DataFrame:
    """One row (tokens, found): how many tokens stand in their text at their offsets. A text is cut into stretches once, so a token is looked up near its place and not from the start of its text."""
    start, length = F.col("start").cast("int"), F.length("text")
    pieces = documents.select("doc_id", F.regexp_extract_all("text", F.lit(f"(?s)(.{{1,{stretch}}})"), F.lit(1)).alias("_pieces"))
    inside = (start % stretch).cast("int")
    near = F.slice("_pieces", F.floor(start / stretch).cast("int") + 1, F.floor((inside + length - 1) / stretch).cast("int") + 1)
    there = F.substring(F.array_join(near, ""), inside + 1, length) == F.col("text")
    return tokens.join(pieces, "doc_id").agg(F.count("*").alias("tokens"), F.count(F.when(there, 1)).alias("found"))


def form_tag(text: str) -> str:
    """guessed_tag of one token without white space."""
    if not text.isalnum() and not any(c.isalnum() for c in text):
        return "."
    low = text.lower()
    if not text[0].isalpha():
        # a pattern's end also stands before a last line separator
        body = text[:-1] if text[-1] in "\x85\u2028\u2029" else text
        if all(unicodedata.category(c)[0] == "N" for c in body):
            return "CD"
    if low in _CLOSED:
        return _CLOSED[low]
    if not low.endswith(_ANY_ENDING):
        return "NN"
    return next((tag for ending, tag in _ENDINGS if low.endswith(ending)), "NN")


def universal(tag: Column) -> Column:
    """The universal part of speech of a treebank tag, X where unknown."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in UNIVERSAL.items() for x in kv])[tag], F.lit("X"))


def tagged(tokens: DataFrame) -> DataFrame:
    """With tag, universal pos (X where unknown) and a confidence for each processor."""
    sure = F.when(F.col("processor") == "space", SURE["space"]).when(F.col("processor") == "word", SURE["word"]).otherwise(SURE["mark"])
    out = tokens.withColumn("tag", guessed_tag(F.col("text")))
    return out.withColumn("pos", universal(F.col("tag"))).withColumn("confidence", sure)


def flags(tokens: DataFrame) -> DataFrame:
    """Stop word, punctuation, alpha, digit, like number, url or email, and shape."""
    text = F.col("text")
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\p{Lu}", "X"), r"\p{Ll}", "x"), r"\p{Nd}", "d")
    return tokens.select(
        "doc_id", "processor", "idx",
        F.lower(text).isin(STOP_WORDS).alias("is_stop"),
        text.rlike(r"^[^\p{L}\p{N}\s]+$").alias("is_punct"),
        text.rlike(r"^\p{L}+$").alias("is_alpha"),
        text.rlike(r"^[0-9]+$").alias("is_digit"),
        text.rlike(r"^[+-]?[0-9][0-9,.]*$").alias("like_num"),
        text.rlike(r"^(https?://|www\.)").alias("like_url"),
        text.rlike(r"^[^@\s]+@[^@\s]+\.[a-z]+$").alias("like_email"),
        shape.alias("shape"),
    )


def pos_category(pos: Column) -> Column:
    return F.when(pos.isin(OPEN_CLASS), "open").when(pos.isin(CLOSED_CLASS), "closed").when(pos.isin(OTHER_CLASS), "other").otherwise("unknown")


def content_words(tokens: DataFrame) -> DataFrame:
    return tokens.where(F.col("pos").isin(CONTENT))


def pos_ngrams(tokens: DataFrame, size: int, most: int = 10) -> DataFrame:
    """(gram, n): the most frequent runs of part-of-speech tags inside a document and processor."""
    order = W.partitionBy("doc_id", "processor").orderBy("idx")
    parts = [F.col("pos"), *(F.lead("pos", k).over(order) for k in range(1, size))]
    grams = tokens.select(F.array(*parts).alias("p")).where(F.get("p", F.lit(size - 1)).isNotNull())
    return grams.groupBy(F.array_join("p", " ").alias("gram")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gram").limit(most)


def statistics(tokens: DataFrame) -> DataFrame:
    """One row for each processor: tokens, documents, mean length, distinct forms and tags."""
    # tokens are counted by form first; what is distinct is counted over forms and over documents, which are far fewer
    forms = tokens.groupBy("processor", F.lower("text").alias("form"), "pos").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    by_form = forms.groupBy("processor", "form").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"))
    counts = by_form.groupBy("processor").agg(F.sum("n").alias("tokens"), F.round(F.sum("chars") / F.sum("n"), 6).alias("mean_length"), F.count("*").alias("forms"))
    tags = forms.select("processor", "pos").distinct().groupBy("processor").agg(F.count("pos").alias("tags"))
    documents = tokens.select("processor", "doc_id").distinct().groupBy("processor").agg(F.count("doc_id").alias("documents"))
    return counts.join(tags, "processor").join(documents, "processor").select("processor", "tokens", "documents", "mean_length", "forms", "tags")


def verb_forms(tokens: DataFrame) -> DataFrame:
    """(tag, n, forms): distinct forms of verbs by tag."""
    return tokens.where("pos = 'VERB'").groupBy("tag").agg(F.count("*").alias("n"), F.countDistinct("text").alias("forms"))


def document_profile(tokens: DataFrame) -> DataFrame:
    """(doc_id, tokens, nouns, verbs, content share) of one processor's tokens."""
    return tokens.groupBy("doc_id").agg(F.count("*").alias("tokens"), F.count(F.when(F.col("pos") == "NOUN", 1)).alias("nouns"), F.count(F.when(F.col("pos") == "VERB", 1)).alias("verbs"), F.round(F.avg(F.when(F.col("pos").isin(CONTENT), 1.0).otherwise(0.0)), 6).alias("content_share"))


def examples(tokens: DataFrame, most: int = 2) -> DataFrame:
    """At most so many tokens for each tag, the first by document and place."""
    return tokens.withColumn("r", F.row_number().over(W.partitionBy("tag").orderBy("doc_id", "idx"))).where(F.col("r") <= most).select("tag", "r", "doc_id", "idx", "text")


def guessed_morph(text: Column, pos: Column) -> Column:
    """Features from suffix and part of speech as `A=b|C=d`, null where the form says nothing."""
    low = F.lower(text)
    return (
        F.when((pos == "VERB") & F.endswith(low, F.lit("ing")), "Tense=Pres|VerbForm=Part")
        .when((pos == "VERB") & F.endswith(low, F.lit("ed")), "Tense=Past|VerbForm=Fin")
        .when((pos == "NOUN") & F.endswith(low, F.lit("s")), "Number=Plur")
        .when(pos == "NOUN", "Number=Sing")
        .when((pos == "ADJ") & F.endswith(low, F.lit("est")), "Degree=Sup")
    )


def parsed_morph(features: Column) -> Column:
    """`A=b|C=d` as a map."""
    return F.str_to_map(features, F.lit("\\|"), F.lit("="))


def with_feature(tokens: DataFrame, feature: str, value: str) -> DataFrame:
    """Tokens whose morph map has the value."""
    return tokens.where(F.element_at("morph", feature) == value)


def types_by_category(tokens: DataFrame) -> DataFrame:
    """(category, types): tags of each part-of-speech category, sorted and unique."""
    return tokens.groupBy(pos_category(F.col("pos")).alias("category")).agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("types"))


def tag_morph(tag: Column, pos: Column) -> Column:
    """Features of a treebank tag and part of speech as `A=b|C=d`, null without any. Fixed values."""
    noun, verb, adj, adv = pos.isin("NOUN", "PROPN"), pos == "VERB", pos == "ADJ", pos == "ADV"
    return (
        F.when(verb & (tag == "VB"), "VerbForm=Inf")
        .when(verb & (tag == "VBD"), "Tense=Past|VerbForm=Fin")
        .when(verb & (tag == "VBG"), "Aspect=Prog|Tense=Pres|VerbForm=Part")
        .when(verb & (tag == "VBN"), "Aspect=Perf|Tense=Past|VerbForm=Part")
        .when(verb & (tag == "VBP"), "Tense=Pres|VerbForm=Fin")
        .when(verb & (tag == "VBZ"), "Number=Sing|Person=3|Tense=Pres|VerbForm=Fin")
        .when(noun & tag.endswith("S"), "Number=Plur")
        .when(noun, "Number=Sing")
        .when((adj | adv) & tag.isin("JJR", "RBR"), "Degree=Cmp")
        .when((adj | adv) & tag.isin("JJS", "RBS"), "Degree=Sup")
        .when(adj, "Degree=Pos")
        .when((pos == "PRON") & (tag == "PRP"), "PronType=Prs")
        .when((pos == "PRON") & (tag == "WP"), "PronType=Int")
    )


def function_words(tokens: DataFrame) -> DataFrame:
    return tokens.where(F.col("pos").isin(CLOSED_CLASS))


def noun_forms(tokens: DataFrame) -> DataFrame:
    """(number, n, forms): nouns by the number of their tag."""
    number = F.when(F.col("tag").endswith("S"), "Plur").otherwise("Sing")
    return tokens.where("pos IN ('NOUN', 'PROPN')").groupBy(number.alias("number")).agg(F.count("*").alias("n"), F.countDistinct("text").alias("forms"))


def feature_table(tokens: DataFrame, deps: DataFrame) -> DataFrame:
    """(doc_id, sent_idx, token_idx, text, pos, relation, head_text, children, lefts, rights) of tokens with a dependency."""
    keys = ["doc_id", "sent_idx"]
    real = deps.where("head <> dependent")
    children = real.groupBy(*keys, F.col("head").alias("token_idx")).agg(F.count("*").alias("children"), F.count(F.when(F.col("dependent") < F.col("head"), 1)).alias("lefts"), F.count(F.when(F.col("dependent") > F.col("head"), 1)).alias("rights"))
    heads = tokens.select(*keys, F.col("token_idx").alias("head"), F.col("text").alias("head_text"))
    own = [F.col("dependent").alias("token_idx"), "head", "relation"]
    if {"dependent_text", "dependent_pos"} <= set(deps.columns):  # dependencies that bring their word need no join
        rows = deps.select(*keys, *own, F.col("dependent_text").alias("text"), F.col("dependent_pos").alias("pos"))
    else:
        rows = tokens.join(deps.select(*keys, *own), [*keys, "token_idx"])
    # sort-merge joins: no table of words goes through the driver
    out = rows.join(heads.hint("merge"), [*keys, "head"]).join(children.hint("merge"), [*keys, "token_idx"], "left").na.fill(0, ["children", "lefts", "rights"])
    return out.select(*keys, "token_idx", "text", "pos", "relation", "head_text", "children", "lefts", "rights")
