"""Ranked search of a stated set of items over all documents, by scanning the texts with an automaton of the items' terms.

No index of the documents is made. The distinct terms of the items, each guarded by a blank on both sides, form an
Aho-Corasick automaton that is broadcast; a text, brought to lower case with each separator turned into a blank,
is read once and gives how often each term occurs. A first scan counts the documents of each term and the corpus
figures, a second one scores: the terms found in a document are spread to the items that hold them, and a task
keeps the best rows of each item only. These few rows are ranked in two rounds, by item and a share of the tasks
first, so no task gets more than a bounded number of rows of one item.

The automaton's size is bounded: items go through in blocks of at most `block_bytes` bytes of text, with one
pair of scans for each block. Nothing is dropped: blocks only cut the item set.

Defined cases: null and empty texts, and texts without a term, match nothing and count nowhere. An item without
terms has no rows. Rows are documents, so repeated rows rank one by one. Equal scores are ordered by ascending id,
a null id last; rows that are equal in score and id come in any order, with ranks of their own. Items of one id
are one item with the terms of all its rows; an item without id is left out. Other columns don't matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window as W

# Fixed values of the contract: characters that end a term (all ASCII but letters and digits), and scoring constants.
SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_TABLE = bytes(0x20 if b in SEPARATORS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))

#: Bytes of item texts in one automaton.
BLOCK_BYTES = 2_000_000
#: Cells of (document, item) scored at once in a task.
CELLS = 1 << 22
#: Shares of the tasks that rank their rows first.
SHARES = 64


def folded(text: str | None) -> str:
    """The text with A-Z lower-cased, each separator as a blank, and a blank at both ends."""
    return " " + (text or "").encode("utf-8", "replace").translate(_TABLE).decode("utf-8") + " "


def terms(text: str | None) -> list[str]:
    return [t for t in folded(text).split(" ") if t]


class Matcher:
    """Terms of a block of items, numbered; the items of each term as slices of one array."""

    def __init__(self, items: list[tuple[object, set[str]]]):
        self.ids = [i for i, _ in items]
        self.terms = sorted({t for _, own in items for t in own})
        number = {t: k for k, t in enumerate(self.terms)}
        pairs = sorted((number[t], k) for k, (_, own) in enumerate(items) for t in own)
        self.items = np.array([k for _, k in pairs], dtype=np.int64)
        self.starts = np.searchsorted(np.array([t for t, _ in pairs], dtype=np.int64), np.arange(len(self.terms) + 1))
        self.automaton = ahocorasick.Automaton()
        for t, k in number.items():
            self.automaton.add_word(f" {t} ", k)
        self.automaton.make_automaton()

    def found(self, text: str | None) -> tuple[int, Counter]:
        """(number of terms of the text with repeats, how often each of the block's terms occurs)."""
        line = folded(text)
        n = len(line.encode("utf-8").split())
        return n, Counter(k for _, k in self.automaton.iter(line)) if n else Counter()


def _blocks(items: DataFrame, item_id: str, text: str, limit: int) -> Iterator[list[tuple[object, set[str]]]]:
    """Blocks of (item id, set of its terms), bounded by bytes of text, read one partition at a time."""
    block: dict[object, set[str]] = {}
    size = 0
    # rows of one id stand together, so that a block that is full ends between two items
    for row in items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("i"), F.col(text).cast("string").alias("t")).orderBy("i").toLocalIterator():
        if size >= limit and row["i"] not in block:
            yield [(i, own) for i, own in block.items() if own]
            block, size = {}, 0
        block.setdefault(row["i"], set()).update(terms(row["t"]))
        size += len(row["t"] or "")
    yield [(i, own) for i, own in block.items() if own]


def _figures(documents: DataFrame, matcher) -> DataFrame:
    """(term, docs, all_terms): term -1 has the documents with a term and the number of all terms, each other number its documents."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matcher.value
        docs, total, df = 0, 0, np.zeros(len(m.terms), dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                n, tf = m.found(text.as_py())
                docs, total = docs + (n > 0), total + n
                df[list(tf)] += 1
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *seen.tolist()], pa.int64()), pa.array([docs, *df[seen].tolist()], pa.int64()), pa.array([total, *[0] * len(seen)], pa.int64())], names=["term", "docs", "all_terms"])

    rows = documents.select(F.col("_text")).mapInArrow(scan, "term long, docs long, all_terms long")
    return rows.groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("all_terms").alias("all_terms"))


class Best:
    """The best rows of each item so far: highest score first, then the smallest id, a missing id (the largest integer) last."""

    def __init__(self, width: int, most: int):
        self.most, self.floor = most, np.ones(width, dtype=np.int64)
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size, self.room = 0, max(CELLS // 4, 2 * width * most)

    def add(self, table: np.ndarray, ids: np.ndarray) -> None:
        """Rows of (document, item) scores; what lies under an item's last kept score can't come in any more."""
        doc, item = np.nonzero(table >= self.floor)
        self.rows.append((item, table[doc, item], ids[doc]))
        self.size += len(doc)
        if self.size > self.room:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        item, score, at = (np.concatenate(x) for x in zip(*self.rows)) if self.rows else (np.zeros(0, dtype=np.int64),) * 3
        order = np.lexsort((at, -score, item))
        item, score, at = item[order], score[order], at[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        last = rank == self.most - 1
        self.floor[item[last]] = score[last]
        keep = rank < self.most
        self.rows = [(item[keep], score[keep], at[keep])]
        self.size = int(keep.sum())
        return self.rows[0]


def _scored(documents: DataFrame, matcher, weights, most: int) -> DataFrame:
    """(item, id, score): of each task the best rows of each item."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, (w, n_docs, n_terms) = matcher.value, weights.value
        table = np.zeros((max(1, CELLS // len(m.ids)), len(m.ids)), dtype=np.int64)
        missing = np.iinfo(np.int64).max
        best, ids = Best(len(m.ids), most), []

        def flush() -> None:
            best.add(table[: len(ids)], np.array(ids, dtype=np.int64))
            table[: len(ids)] = 0
            ids.clear()

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                n, tf = m.found(text.as_py())
                if not tf:
                    continue
                k, c = np.fromiter(tf.keys(), np.int64, len(tf)), np.fromiter(tf.values(), np.int64, len(tf))
                length = 100 - 50 + (50 * n * n_docs) // n_terms
                gain = w[k] * ((1_000_000_000 * c) // (1000 * c + 20 * length))
                often = m.starts[k + 1] - m.starts[k]
                ends = np.cumsum(often)
                places = np.repeat(m.starts[k] - (ends - often), often) + np.arange(ends[-1])
                np.add.at(table[len(ids)], m.items[places], np.repeat(gain, often))
                ids.append(missing if doc is None else doc)
                if len(ids) == len(table):
                    flush()
        flush()
        item, score, at = best.settle()
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(at, pa.int64(), mask=at == missing), pa.array(score, pa.int64())], names=["item", "id", "score"])

    return documents.select("_id", "_text").mapInArrow(scan, "item long, id long, score long")


def rank_documents(documents: DataFrame, items: DataFrame, most: int = 50, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item id, rank, document id, score): the `most` documents of highest score above 0 for each item. Document ids are integers."""
    spark = documents.sparkSession
    docs = documents.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("string").alias("_text"))
    kind = items.schema[item_id].dataType
    out = None
    for block in _blocks(items, item_id, text, block_bytes):
        if not block:
            continue
        matcher = spark.sparkContext.broadcast(Matcher(block))
        figures = {r["term"]: r for r in _figures(docs, matcher).collect()}  # one row for each term of the block
        n_docs, n_terms = (figures[-1]["docs"], figures[-1]["all_terms"]) if -1 in figures else (0, 0)
        df = np.array([figures[k]["docs"] if k in figures else 0 for k in range(len(matcher.value.terms))], dtype=np.int64)
        weights = spark.sparkContext.broadcast((np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64), n_docs, n_terms))
        order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
        rows = _scored(docs, matcher, weights, most).withColumn("_share", F.spark_partition_id() % SHARES)
        rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("item", "_share").orderBy(*order))).where(F.col("rank") <= most)
        rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).where(F.col("rank") <= most)
        names = spark.createDataFrame([(k, i) for k, i in enumerate(matcher.value.ids)], StructType([StructField("item", LongType()), StructField(item_id, kind)]))
        named = rows.join(F.broadcast(names), "item").select(item_id, F.col("rank").cast("int").alias("rank"), F.col("id").alias(doc_id), "score")  # names: the ids of one block
        out = named if out is None else out.unionByName(named)
    if out is None:
        return items.select(item_id, F.lit(0).alias("rank"), F.lit(0).cast("long").alias(doc_id), F.lit(0).cast("long").alias("score")).limit(0)
    return out


SEARCH_SQL = r"""
    WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
    f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM f GROUP BY doc_id),
    g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM d), df AS (SELECT term, count(*) AS df FROM f GROUP BY term),
    q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
    w AS (SELECT item_id, term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w FROM q JOIN df USING (term) CROSS JOIN g),
    s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // terms))))::BIGINT AS score FROM w JOIN f USING (term) JOIN d USING (doc_id) CROSS JOIN g GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
    SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 50"""
