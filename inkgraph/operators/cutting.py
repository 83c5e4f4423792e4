"""Texts cut into tokens by vectorised passes over many texts at once, in the task that holds them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgraph.operators.tokens import SURE, UNIVERSAL, form_tag

#: White space as in Spark's and DuckDB's patterns.
_SPACES = r" \t\n\x0b\f\r"
#: tokens.PATTERNS in Python's terms.
CUTS = {name: re.compile(f"({p})") for name, p in {"space": f"[^{_SPACES}]+", "word": r"[^\W_]+", "mark": rf"[^\W_]+|[^\w{_SPACES}]|_"}.items()}
#: Texts that are cut at once, in characters; rows of one batch that leaves a task; bytes of text of a task.
STEP, ROWS, BUCKET = 1 << 20, 1 << 16, 8 << 20


def text_parts(documents: DataFrame) -> int:
    """Partitions for the texts of documents (text), as many as they are large."""
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(documents.sparkSession.sparkContext.defaultParallelism, -(-size // BUCKET))


def dealt_texts(documents: DataFrame) -> DataFrame:
    """(doc_id, text) dealt by document, rows of one document behind each other."""
    return documents.select("doc_id", "text").repartition(text_parts(documents), "doc_id").sortWithinPartitions("doc_id")


def whole_documents(batches: Iterator[pa.RecordBatch], step: int = STEP) -> Iterator[tuple[pa.Array, list[str]]]:
    """(ids, texts) of batches (doc_id, text) in turn, in stretches of so many characters; rows of one document that come behind each other stay together."""
    ids, texts, size, kind = [], [], 0, None
    for batch in batches:
        kind = batch.column(0).type
        for k in range(batch.num_rows):
            doc, text = batch.column(0)[k].as_py(), batch.column(1)[k].as_py() or ""
            if size >= step and doc != ids[-1]:
                yield pa.array(ids, kind), texts
                ids, texts, size = [], [], 0
            ids.append(doc)
            texts.append(text)
            size += len(text)
    if ids:
        yield pa.array(ids, kind), texts


def cut(texts: list[str], pattern: re.Pattern) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(tokens of all texts, how many of each text, their starts and ends in it in code points); the pattern is one group."""
    pieces: list[str] = []
    counts = []
    for text in texts:
        found = pattern.split(text)
        found.pop()  # what stands behind the last token
        pieces += found
        counts.append(len(found) // 2)
    n = np.array(counts, np.int64)
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ends = np.cumsum(lengths)[1::2]
    ends -= np.repeat(np.concatenate(([0], ends))[np.cumsum(n) - n], n)
    return pieces[1::2], n, ends - lengths[1::2], ends


def coded(values: list[str]) -> tuple[np.ndarray, list[str]]:
    """The place of each value among the distinct ones, and these."""
    found = pa.array(values, pa.string()).dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False), found.dictionary.to_pylist()


def in_rows(columns: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
    """The columns as batches of bounded size."""
    rows = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    for a in range(0, rows.num_rows, ROWS):
        yield rows.slice(a, ROWS)


def tagged_texts(documents: DataFrame, processor: str) -> DataFrame:
    """`tokens.tagged` tokens of one of the rule tokenizers, cut and tagged many texts at once: a form is tagged once for all its tokens."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in whole_documents(batches):
            words, n, start, end = cut(texts, CUTS[processor])
            code, forms = coded(words)
            tags = [form_tag(x) for x in forms]
            of = lambda values: pa.array(values, pa.string()).take(pa.array(code))
            yield from in_rows({
                "doc_id": ids.take(pa.array(np.repeat(np.arange(len(n)), n))), "idx": pa.array((np.arange(len(code)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)),
                "text": of(forms), "start": pa.array(start), "end": pa.array(end), "tag": of(tags), "pos": of([UNIVERSAL.get(t, "X") for t in tags]),
            })

    kind = documents.schema["doc_id"].dataType.simpleString()
    found = documents.select("doc_id", "text").repartition(text_parts(documents)).mapInArrow(rows, f"doc_id {kind}, idx int, text string, start long, end long, tag string, pos string")
    return found.select("doc_id", F.lit(processor).alias("processor"), "idx", "text", "start", "end", "tag", "pos", F.lit(SURE[processor]).alias("confidence"))
