"""Inventory of element paths in XML: which paths occur in a corpus and how often, attributes included.

A path is the names of the elements below the root, joined by an arrow; the root itself has none. An attribute is a node
behind its element's path (behind the root's name for the root), with its value unless the path tells an identifier or a
reference; values are cut at 512 characters. Elements whose name has math or formula in it are passed over with all
below them, attributes of such a name as well. Prefixes and namespaces are left out of names.

The walk is driven by parse events and keeps the open path only, so memory grows with depth, not with the document.
Each task adds up its paths before the shuffle. Members that aren't well formed add nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ARROW = " → "
LONGEST = 512
#: Distinct paths that a task keeps before it hands them on.
KEPT = 100_000

# Attributes behind these paths are counted without their value.
WITHOUT_VALUE = (
    "article → @id", "sub-article → @id", "sub-article → front-stub → related-article → @id", "ack → @id", "ack → p → @id", "abbrev → @id", "abbrev → @title", "award-id → @rid", "→ @href", "→ @id", "ext-link → @id", "xref → @rid",
    "ref → @id", "mixed-citation → @id", "supplementary-material → @id", "sec → @id", "fig → @id", "contrib → @id", "kwd → @id", "aff → @id", "table-wrap → @id", "app → @id", "fn → @id", "fn-group → @id", "term → @id",
    "related-object → @source-id", "related-article → @page", "issue → @seq", "corresp → @id", "boxed-text → @id", "abstract → @id", "graphic → @id", "table → @id", "sec → p → @id", "term → @id", "def → @id", "body → @id",
)


def _bare(name: str) -> str:
    return name.rpartition(":")[2]


def _passed(name: str) -> bool:
    return "math" in name.lower() or "formula" in name.lower()


def paths_of(text: str) -> Counter:
    """Counts of the paths of one document; raises expat.ExpatError."""
    counts: Counter = Counter()
    path: list[str] = []
    state = {"hidden": 0, "depth": 0, "root": ""}
    parser = expat.ParserCreate("utf-8")
    parser.ordered_attributes = True

    def start(tag: str, attributes: list[str]) -> None:
        name = _bare(tag)
        if state["hidden"] or _passed(name):
            state["hidden"] += 1
            return
        if state["depth"]:
            path.append(name)
        else:
            state["root"] = name
        state["depth"] += 1
        here = ARROW.join(path)
        if here:
            counts[here] += 1
        for key, value in zip(attributes[::2], attributes[1::2]):
            if key.partition(":")[0] == "xmlns" or _passed(_bare(key)):
                continue
            key = _bare(key)
            node = f"{here or state['root']}{ARROW}@{key}"
            if key.lower() != "href" and not any(x in node for x in WITHOUT_VALUE):
                node += "=" + (value if len(value) <= LONGEST else value[:LONGEST] + "…")
            counts[node] += 1

    def end(_: str) -> None:
        if state["hidden"]:
            state["hidden"] -= 1
            return
        state["depth"] -= 1
        if path:
            path.pop()

    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.Parse(text.encode("utf-8"), True)
    return counts


def path_counts(documents: DataFrame, column: str = "xml") -> DataFrame:
    """(path, n) over the XML texts of a column."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["path", "n"])

        for b in batches:
            for text in b.column(0):
                try:
                    counts.update(paths_of(text.as_py() or ""))
                except expat.ExpatError:
                    continue
                if len(counts) > KEPT:
                    yield batch()
                    counts.clear()
        yield batch()

    rows = documents.select(F.col(column).cast("string").alias("xml")).mapInArrow(count, "path string, n long")
    return rows.groupBy("path").agg(F.sum("n").alias("n"))


def element_paths(counts: DataFrame) -> DataFrame:
    """(path): the distinct element paths, attributes left out."""
    return counts.where(~F.col("path").contains(ARROW + "@")).select("path").distinct()


def merged(counts: DataFrame, earlier: DataFrame) -> DataFrame:
    """(path, n): counts added to those of an earlier run."""
    return counts.select("path", "n").unionByName(earlier.select("path", "n")).groupBy("path").agg(F.sum("n").alias("n"))


def as_lines(counts: DataFrame) -> DataFrame:
    """(value): lines `(n) path` for a text file, paths with math or formula left out."""
    return counts.where(~F.lower("path").rlike("math|formula")).select(F.concat(F.lit("("), F.col("n").cast("string"), F.lit(") "), F.col("path")).alias("value"))


def from_lines(lines: DataFrame) -> DataFrame:
    """(path, n) of such lines; a line without a number counts 1, blank lines go. Of a repeated path the counts add up."""
    line = F.trim("value")
    numbered = line.rlike(r"^\(\d+\) ")
    rows = lines.where(line != "").select(F.when(numbered, F.regexp_replace(line, r"^\(\d+\) ", "")).otherwise(line).alias("path"), F.when(numbered, F.regexp_extract(line, r"^\((\d+)\) ", 1).cast("long")).otherwise(F.lit(1).cast("long")).alias("n"))
    return rows.groupBy("path").agg(F.sum("n").alias("n"))
