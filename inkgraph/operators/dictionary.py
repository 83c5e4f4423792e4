"""Terms of a dictionary found in texts of any length, all in one pass.

The terms form a trie with failure links, built once on the driver and broadcast, so the time to read a text doesn't
grow with the number of terms. The size of one trie is bounded by bytes of terms; a larger dictionary goes through in
blocks, with a pass of the texts for each, and nothing is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of terms in one trie.
BLOCK_BYTES = 4_000_000
#: Hits in a batch.
BATCH = 50_000


def folded(text: str) -> str:
    """Lower case, one character for each: a character whose lower case is longer stays as it is, so offsets hold."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _tries(terms: DataFrame, term: str, limit: int) -> Iterator[ahocorasick.Automaton]:
    trie, size = ahocorasick.Automaton(), 0
    rows = terms.select(F.col(term).cast("string").alias("t")).where("t IS NOT NULL AND t <> ''").distinct()
    for row in rows.toLocalIterator():
        key = folded(row["t"])
        trie.add_word(key, (*trie.get(key, ()), row["t"]))
        size += len(row["t"].encode())
        if size >= limit:
            yield trie
            trie, size = ahocorasick.Automaton(), 0
    if len(trie):
        yield trie


def dictionary_hits(documents: DataFrame, terms: DataFrame, doc_id: str = "doc_id", text: str = "text", term: str = "term", words_only: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, term, start, end, text): where each term occurs in any case, as code-point offsets.

    Hits of one term don't overlap: from the left, the next begins behind the last. Hits of different terms may.
    words_only keeps hits with neither a letter nor a digit at their sides. Null and empty texts and terms give nothing,
    terms that differ in case only are terms of their own, repeated terms count once, repeated rows are searched each.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text"))
    kind = docs.schema["_id"].dataType.simpleString()
    out = None
    for trie in _tries(terms, term, block_bytes):
        trie.make_automaton()
        shared = spark.sparkContext.broadcast(trie)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            automaton = shared.value
            for b in batches:
                rows: list[tuple] = []
                ids = b.column(0)

                def batch() -> pa.RecordBatch:
                    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], ids.type), *(pa.array([r[k] for r in rows], t) for k, t in ((1, pa.string()), (2, pa.int64()), (3, pa.int64()), (4, pa.string())))], names=["doc_id", "term", "start", "end", "text"])

                for key, line in zip(ids.to_pylist(), b.column(1)):
                    raw = line.as_py() or ""
                    low, behind = folded(raw), {}
                    for last, names in automaton.iter(low):
                        n, end = len(names[0]), last + 1
                        start = end - n
                        if words_only and (start and low[start - 1].isalnum() or end < len(low) and low[end].isalnum()):
                            continue
                        for name in names:
                            if behind.get(name, 0) <= start:
                                behind[name] = end
                                rows.append((key, name, start, end, raw[start:end]))
                    if len(rows) > BATCH:
                        yield batch()
                        rows.clear()
                yield batch()

        hits = docs.mapInArrow(scan, f"doc_id {kind}, term string, start long, end long, text string")
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        return docs.select(F.col("_id").alias("doc_id"), F.lit("").alias("term"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), F.lit("").alias("text")).limit(0)
    return out


def keyword_entities(documents: DataFrame, terms: DataFrame, priority: int = 4, confidence: float = 0.70) -> DataFrame:
    """(doc_id, start, end, text, label, priority, confidence): the dictionary as the last stage of an entity cascade; a span found for several terms counts once."""
    hits = dictionary_hits(documents, terms).select("doc_id", "start", "end", "text").distinct()
    return hits.select("*", F.lit("KEYWORD").alias("label"), F.lit(priority).alias("priority"), F.lit(confidence).alias("confidence"))
