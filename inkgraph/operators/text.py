"""Text preparation: headings, front matter, sentences, chunks, hashes and versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def first_heading(text: Column) -> Column:
    """The first level-1 heading, null without one."""
    return F.get(F.transform(F.filter(F.split(text, "\n"), lambda line: F.trim(line).rlike("^# ")), lambda line: F.trim(F.substring(F.trim(line), 3, 1 << 30))), F.lit(0))


def headings_end_with_period(text: Column) -> Column:
    return F.regexp_replace(text, r"(?m)^(#{1,6})\s+([^\n]*[^\n.\s])[ \t]*$", "$1 $2.")


def without_front_matter_and_references(text: Column) -> Column:
    """Without a leading --- block and without all from a References heading on. An unclosed block stays."""
    body = F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n", "")
    return F.regexp_replace(body, r"(?ims)^#{1,6}\s*(References|Bibliography|Citations)\s*$.*", "")


def sentences(documents: DataFrame) -> DataFrame:
    """(doc_id, sent_idx, sentence): cut behind . ! ? and white space."""
    return documents.select("doc_id", F.posexplode(F.split("text", r"(?<=[.!?])\s+")).alias("sent_idx", "sentence"))


def filtered_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, line, filtered_start, original_start, length): the lines that Markdown filtering keeps, and where they come from.

    Blocks between --- lines, all from a References heading on, and table lines go. An unclosed --- is
    kept as text. Kept lines are joined by line ends; offsets count code points.
    """
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "s"))
    order = W.partitionBy("doc_id").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("doc_id")
    fence = F.trim("s") == "---"
    lines = lines.withColumn("original_start", F.sum(F.length("s") + 1).over(order) - F.length("s") - 1).withColumn("f", F.sum(F.when(fence, 1).otherwise(0)).over(order)).withColumn("fences", F.sum(F.when(fence, 1).otherwise(0)).over(whole))
    closed = F.col("fences") - F.col("fences") % 2
    in_block = (F.col("f") <= closed) & ((F.col("f") % 2 == 1) | fence)
    table = F.trim("s").rlike(r"^\|.*\|$")
    kept = lines.where(~in_block).withColumn("tail", F.max(F.when(F.lower("s").rlike(r"^#{1,6}\s*(references|bibliography|citations)\s*$"), 1).otherwise(0)).over(order)).where((F.col("tail") == 0) & ~table)
    return kept.select("doc_id", "line", F.col("s").alias("text"), (F.sum(F.length("s") + 1).over(order) - F.length("s") - 1).alias("filtered_start"), "original_start", F.length("s").alias("length"))


def markdown_pieces(documents: DataFrame) -> DataFrame:
    """(doc_id, line, text, filtered_start, original_start, length): the pieces that Markdown filtering keeps; joined in order they are the filtered text.

    Blocks between --- lines go, an open one to the end of the text; so does all from a References,
    Bibliography or Citations heading of level 1 or 2 on. Of tables go the row before a separator, the separator and the rows
    behind it; rows without a separator stay. Headings lose their # and get a final period, which
    is a piece of its own and comes from the heading's last character. The line end belongs to the last
    piece of a line, but of a heading is a piece of its own; the last line has none. A null text has no pieces. Offsets count code points.
    """
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "s"))
    order = W.partitionBy("doc_id").orderBy("line")
    to_here, before = order.rowsBetween(W.unboundedPreceding, 0), order.rowsBetween(W.unboundedPreceding, -1)
    flag = lambda c: F.when(c, 1).otherwise(0)
    s, fence = F.col("s"), F.col("s").rlike(r"^---\s*$")
    separator, row = s.rlike(r"^\s*\|[\s\-:|]+\|\s*$"), s.rlike(r"^\s*\|.+\|\s*$")
    lines = lines.withColumn("at", F.coalesce(F.sum(F.length("s") + 1).over(before), F.lit(0))).withColumn("f", F.sum(flag(fence)).over(to_here)).withColumn("next", F.lead("s").over(order))
    open_lines = lines.where(~fence & (F.col("f") % 2 == 0))
    open_lines = open_lines.withColumn("tail", F.max(flag(s.rlike(r"(?i)^##?\s*(References|Bibliography|Citations)\s*$"))).over(to_here)).withColumn("in_table", F.last(F.when(separator, True).when(~row, False), True).over(before))
    in_table = row & (separator | F.coalesce("in_table", F.lit(False)) | F.coalesce(F.col("next").rlike(r"^\s*\|[\s\-:|]+\|\s*$"), F.lit(False)))
    kept = open_lines.where((F.col("tail") == 0) & ~in_table)
    heading = s.rlike(r"(?s)^#{1,6}\s+.")
    title = F.regexp_extract("s", r"(?s)^#{1,6}\s+(.*?)\s*$", 1)
    newline = F.when(F.col("next").isNull(), "").otherwise("\n")
    prefix = F.length(F.regexp_extract("s", r"^#{1,6}\s+", 0))
    piece = lambda words, place: F.struct(words.alias("text"), place.cast("long").alias("original_start"))
    dot = F.when(title.endswith("."), "").otherwise(".")
    of_heading = F.array(piece(title, F.col("at") + prefix), piece(dot, F.col("at") + prefix + F.greatest(F.length(title) - 1, F.lit(0))), piece(newline, F.col("at") + F.length("s")))
    pieces = kept.select("doc_id", "line", F.posexplode(F.filter(F.when(heading, of_heading).otherwise(F.array(piece(F.concat(s, newline), F.col("at")))), lambda x: x["text"] != "")).alias("part", "p"))
    along = W.partitionBy("doc_id").orderBy("line", "part").rowsBetween(W.unboundedPreceding, 0)
    return pieces.select("doc_id", "line", "p.text", (F.sum(F.length("p.text")).over(along) - F.length("p.text")).alias("filtered_start"), "p.original_start", F.length("p.text").alias("length"))


def joined_pieces(documents: DataFrame, pieces: DataFrame) -> DataFrame:
    """(doc_id, text): the filtered text of each document, empty where nothing is kept."""
    whole = pieces.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("filtered_start", "text"))), lambda x: x["text"]), "").alias("text"))
    return documents.select("doc_id").join(whole, "doc_id", "left").na.fill("", ["text"])


def split_like(documents: DataFrame, parts: DataFrame, window: int = 200) -> DataFrame:
    """(doc_id, chunk_no, start, end, text): each text cut in proportion to the parts (doc_id, chunk_no, n_chars) of another form of it.

    A cut lies its part's share of the text behind the one before, and moves behind the last empty line within `window`
    characters of it, if that lies behind the cut before. The last part takes the rest, so the parts make up the
    text again. Parts without any characters in all share the text as if all were equal. Documents without parts
    have no rows; a null text counts as empty. Cuts depend on those before, so a document's are found by a fold over its parts.
    """
    order = F.array_sort(F.collect_list(F.struct("chunk_no", F.coalesce("n_chars", F.lit(0)).alias("n"))))
    per = parts.groupBy("doc_id").agg(order.alias("parts"), F.sum(F.coalesce("n_chars", F.lit(0))).alias("total"))
    known = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = known.withColumn("size", F.length("text")).join(per, "doc_id")
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  a value that is used several times is found once
    span = lambda part, start, end: F.struct(part["chunk_no"].alias("chunk_no"), start.alias("start"), end.alias("end"))

    def cut(acc: Column, part: Column) -> Column:
        share = F.when(F.col("total") > 0, F.floor(F.col("size") * part["n"] / F.col("total"))).otherwise(F.floor(F.col("size") / F.size("parts"))).cast("int")

        def moved(end: Column) -> Column:
            low = F.greatest(end - window, F.lit(0))
            near = F.substring("text", low + 1, F.least(end + window, F.col("size")) - low)
            back = lambda w: once(F.locate("\n\n", F.reverse(w)), lambda k: F.when(k > 0, low + F.length(w) - k + 1).otherwise(end))
            return once(once(near, back), lambda m: F.when(m > acc["begin"], m).otherwise(end))

        closed = lambda end: F.struct(F.concat(acc["done"], F.array(span(part, acc["begin"], end))).alias("done"), end.alias("begin"))
        return once(once(F.least(acc["begin"] + share, F.col("size")), moved), closed)

    kind = rows.select("parts").schema["parts"].dataType.elementType["chunk_no"].dataType.simpleString()
    start = F.struct(F.array().cast(f"array<struct<chunk_no:{kind},start:int,end:int>>").alias("done"), F.lit(0).alias("begin"))
    firsts, last = F.slice("parts", F.lit(1), F.size("parts") - 1), F.element_at("parts", -1)
    spans = F.aggregate(firsts, start, cut, lambda acc: F.concat(acc["done"], F.array(span(last, acc["begin"], F.col("size")))))
    # explode_outer: explode would have the fold done once more, for a filter on its size
    out = rows.select("doc_id", "text", F.explode_outer(spans).alias("x"))
    return out.select("doc_id", "x.*", F.substring("text", F.col("x.start") + 1, F.col("x.end") - F.col("x.start")).alias("text"))


def to_original(offsets: DataFrame, segments: DataFrame) -> DataFrame:
    """(doc_id, offset, original) by the last segment that begins at or before the offset: one sort of both tables by document."""
    a = segments.select("doc_id", F.col("filtered_start").alias("at"), F.lit(0).alias("kind"), F.col("original_start").alias("o"), F.col("filtered_start").alias("f"))
    b = offsets.select("doc_id", F.col("offset").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("o"), F.lit(None).cast("long").alias("f"))
    order = W.partitionBy("doc_id").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("lo", F.last("o", True).over(order)).withColumn("lf", F.last("f", True).over(order))
    return both.where("kind = 1").select("doc_id", F.col("at").alias("offset"), F.when(F.col("at") < 0, 0).otherwise(F.coalesce(F.col("lo") + F.col("at") - F.col("lf"), F.col("at"))).alias("original"))


def chunks(documents: DataFrame, max_tokens: int = 200, overlap: int = 0) -> DataFrame:
    """(doc_id, chunk_no, text, n_tokens, oversize): paragraphs packed in order up to max_tokens; a token is four characters.

    A paragraph over the limit is packed by its sentences; a sentence over the limit stays whole and is
    marked. overlap: a chunk begins with the longest run of last sentences of the one before that has at
    most so many tokens. Pieces of one document are folded in order.
    """
    size = lambda s: F.ceil(F.length(s) / 4.0).cast("int")
    pieces = F.flatten(F.transform(F.filter(F.split("text", r"\n+"), lambda p: F.trim(p) != ""), lambda p: F.when(size(p) > max_tokens, F.split(p, r"(?<=[.!?])\s+")).otherwise(F.array(p))))
    kind = "struct<done:array<string>,open:string,own:boolean>"
    init = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(False).alias("own")).cast(kind)

    def tail(s: Column) -> Column:
        if not overlap:
            return F.lit("")
        parts = F.split(s, r"(?<=[.!?])\s+")
        runs = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), " "))
        return F.when(F.size(parts) > 1, F.coalesce(F.get(F.filter(runs, lambda r: size(r) <= overlap), F.lit(0)), F.lit(""))).otherwise("")

    def step(acc: Column, p: Column) -> Column:
        longer = F.when(acc["open"] == "", p).otherwise(F.concat(acc["open"], F.lit("\n"), p))
        fits = ~acc["own"] | (size(longer) <= max_tokens)  # what a chunk has from the one before doesn't close it
        kept = tail(acc["open"])
        fresh = F.when(kept == "", p).otherwise(F.concat(kept, F.lit("\n"), p))
        return F.struct(F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))).alias("done"), F.when(fits, longer).otherwise(fresh).alias("open"), F.lit(True).alias("own"))

    folded = F.aggregate(pieces, init, step, lambda acc: F.filter(F.concat(acc["done"], F.array(acc["open"])), lambda s: s != ""))
    return documents.select("doc_id", F.posexplode(folded).alias("chunk_no", "text")).withColumn("n_tokens", size(F.col("text"))).withColumn("oversize", F.col("n_tokens") > max_tokens)


def merged(chunk_rows: DataFrame) -> DataFrame:
    """(doc_id, text): chunks joined again in order by an empty line; front matter stays in the first alone."""
    body = lambda x: F.when(x["chunk_no"] == 0, x["text"]).otherwise(F.regexp_replace(x["text"], r"(?s)\A---\n.*?\n---\n", ""))
    return chunk_rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "text"))).alias("c")).select("doc_id", F.array_join(F.transform("c", body), "\n\n").alias("text"))


def captions_only(text: Column) -> Column:
    """HTML tables and figures reduced to the text of their caption; without one they go."""
    inside = r"(?:(?!</\1>).)*?"
    kept = F.regexp_replace(text, rf"(?is)<(table|figure)\b{inside}<(?:fig)?caption[^>]*>((?:(?!</\1>).)*?)</(?:fig)?caption>{inside}</\1>", "$2")
    return F.regexp_replace(kept, r"(?is)<(table|figure)\b.*?</\1>", "")


def parsed(documents: DataFrame) -> DataFrame:
    """(doc_id, front, body, references): the `key: value` lines of leading front matter as a map, the text behind it, and the numbered lines `[n]: text` as a map."""
    block = F.regexp_extract("text", r"(?s)\A---\n(.*?)\n---\n", 1)
    entries = lambda lines, pattern: F.map_from_entries(F.array_distinct(F.transform(F.filter(lines, lambda x: x.rlike(pattern)), lambda x: F.struct(F.regexp_extract(x, pattern, 1).alias("k"), F.trim(F.regexp_extract(x, pattern, 2)).alias("v")))))
    first = lambda m: F.map_from_entries(F.map_entries(m))
    lines = F.split("text", "\n")
    return documents.select("doc_id", first(entries(F.split(block, "\n"), r"^([A-Za-z_][\w-]*):\s*(.*)$")).alias("front"), F.regexp_replace("text", r"(?s)\A---\n.*?\n---\n", "").alias("body"), first(entries(lines, r"^\[(\d+)\]:?\s+(.*)$")).alias("references"))


def spans_to_original(spans: DataFrame, segments: DataFrame) -> DataFrame:
    """(doc_id, start, end, original_start, original_end): the start by its own place, the end by that of the last character, plus one."""
    wanted = spans.select("doc_id", F.explode(F.array("start", F.col("end") - 1)).alias("offset")).distinct()
    found = to_original(wanted, segments)
    a, b = found.select("doc_id", F.col("offset").alias("start"), F.col("original").alias("original_start")), found.select("doc_id", (F.col("offset") + 1).alias("end"), (F.col("original") + 1).alias("original_end"))
    return spans.join(a, ["doc_id", "start"]).join(b, ["doc_id", "end"]).select("doc_id", "start", "end", "original_start", "original_end")


def pages_to_chunks(pages: DataFrame, size: int = 18_000, overlap: int = 1_000) -> DataFrame:
    """(doc_id, chunk_no, first_page, last_page, text): the pages of a document (doc_id, page, text), one behind the other, in pieces of `size` characters that overlap."""
    order = W.partitionBy("doc_id").orderBy("page").rowsBetween(W.unboundedPreceding, 0)
    ends = pages.withColumn("e", F.sum(F.length("text")).over(order)).withColumn("s", F.col("e") - F.length("text"))
    step = size - overlap
    # each page names the pieces that it has a part of
    low = F.greatest(F.lit(0), F.ceil((F.col("s") - size + 1) / F.lit(float(step)))).cast("int")
    pieces = ends.where("e > s").withColumn("total", F.max("e").over(W.partitionBy("doc_id"))).withColumn("chunk_no", F.explode(F.sequence(low, F.floor((F.col("e") - 1) / F.lit(float(step))).cast("int"))))
    begin = F.col("chunk_no") * step
    own = pieces.where((F.col("chunk_no") == 0) | (begin + overlap < F.col("total"))).withColumn("part", F.substring("text", (F.greatest(begin - F.col("s"), F.lit(0)) + 1).cast("int"), (F.least(begin + size, F.col("e")) - F.greatest(begin, F.col("s"))).cast("int"))).where("part <> ''")
    return own.groupBy("doc_id", "chunk_no").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "part"))), lambda x: x["part"]), "").alias("text"))


def readiness(documents: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """(doc_id, <name> count for each of parts, missing, is_ready): how many rows of each table a document has, and which it lacks."""
    out = documents.select("doc_id")
    for name, rows in parts.items():
        out = out.join(rows.groupBy("doc_id").agg(F.count("*").alias(name)), "doc_id", "left")
    out = out.na.fill(0, list(parts))
    missing = F.concat_ws(",", *(F.when(F.col(k) == 0, F.lit(k)) for k in parts))
    return out.withColumn("missing", missing).withColumn("is_ready", F.col("missing") == "")


def without_documents(gone: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Each table (with a doc_id) without the rows of the documents that go."""
    return {name: rows.join(gone.select("doc_id"), "doc_id", "left_anti") for name, rows in tables.items()}


def content_hashes(documents: DataFrame) -> DataFrame:
    """(hash, doc_id, copies): the smallest id of each content."""
    return documents.groupBy(F.md5("text").alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


#: Versions of a text, the first that is there is active.
VERSIONS = ("user", "formatted", "raw", "legacy")


def active_version(documents: DataFrame, selected: str | None = None) -> DataFrame:
    """(doc_id, version, text): user text before formatted before raw before legacy, of columns user_text and so on; those that are missing count as null.

    A column named by `selected` holds the version wanted for a document: it is taken as it is, null text
    where it is not there; null or an unknown name leaves the order above.
    """
    have = [v for v in VERSIONS if f"{v}_text" in documents.columns]
    first = F.coalesce(*(F.when(F.col(f"{v}_text").isNotNull(), F.lit(v)) for v in have))
    version = first if selected is None else F.coalesce(F.when(F.col(selected).isin(*VERSIONS), F.col(selected)), first)
    texts = F.coalesce(*(F.when(F.col("version") == v, F.col(f"{v}_text")) for v in have))
    return documents.withColumn("version", version).select("doc_id", "version", texts.alias("text"))


def absolute_images(text: Column, base: str) -> Column:
    """Relative image links behind a base address; absolute ones stay."""
    return F.regexp_replace(text, r"(!\[[^\]]*\]\()(?!https?://|/|data:)([^)\s]+)", f"$1{base}$2")


def top_left_boxes(boxes: DataFrame, heights: DataFrame) -> DataFrame:
    """Boxes from bottom-left to top-left origin, with width and height."""
    return boxes.join(heights, ["doc_id", "page"]).select("doc_id", "page", F.col("x0").alias("x"), (F.col("page_height") - F.col("y1")).alias("y"), (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height"))
