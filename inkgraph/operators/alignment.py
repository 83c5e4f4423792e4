"""Places in the text for tokens that another tokenizer made."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Columns of a placed token.
TYPES = {"idx": pa.int32(), "text": pa.string(), "start": pa.int32(), "end": pa.int32(), "found": pa.bool_()}
#: Placed tokens that are handed on together.
ROWS = 20_000


def _places(text: str | None, tokens) -> list[tuple]:
    """A token that occurs nowhere behind one place occurs nowhere behind a later one, so each absent form is searched for once."""
    text, at, absent, out = text or "", 0, set(), []
    for k, token in enumerate(tokens):
        if token is None:
            out.append((k, None, at, at, False))
            continue
        start = -1 if token in absent else text.find(token, at)
        if start < 0:
            absent.add(token)
        begin = at if start < 0 else start
        at = begin + len(token)
        out.append((k, token, begin, at, start >= 0))
    return out


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of placed tokens, handed on document by document once there are so many, so that a batch of long texts is never held as Python objects."""
    for batch in batches:
        ids, texts, lists = batch.column(0), batch.column(1), batch.column(2)
        at, rows = [], []
        for i in range(batch.num_rows):
            found = _places(texts[i].as_py(), lists[i].as_py() or ())
            at += [i] * len(found)
            rows += found
            if len(rows) >= ROWS or i == batch.num_rows - 1:
                columns = list(zip(*rows)) or [()] * len(TYPES)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, TYPES.values()))], ["doc_id", *TYPES])
                at, rows = [], []


def align_tokens(texts: DataFrame, tokens: DataFrame) -> DataFrame:
    """(doc_id, idx, text, start, end, found) of a foreign token list: texts (doc_id, text), tokens (doc_id, tokens: array<string>).

    A token stands at its next occurrence from the end of the token before it; one that does not occur
    there stands at that end and reaches as far as it is long, which may be behind the text's end, and
    found is false. Offsets count code points. A null token takes no place; a text that is null or
    missing is empty; documents without a list, or with an empty one, give no rows. A document's list is one row.
    """
    lists = tokens.select("doc_id", F.col("tokens").alias("_tokens"))
    rows = lists.join(texts.select("doc_id", F.col("text").alias("_text")), "doc_id", "left")
    kind = StructType([rows.schema["doc_id"], *StructType.fromDDL("idx int, text string, start int, end int, found boolean").fields])
    return rows.select("doc_id", "_text", "_tokens").mapInArrow(_aligned, kind)


def token_lists(tokens: DataFrame) -> DataFrame:
    """(doc_id, tokens) of token rows (doc_id, idx, text), in the order of idx; equal idx by text."""
    rows = tokens.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("x"))
    return rows.select("doc_id", F.col("x.text").alias("tokens"))


def alignment_report(aligned: DataFrame) -> DataFrame:
    """(doc_id, tokens, found, last_end): tokens of a document, those found in it, and the end of the last place."""
    return aligned.groupBy("doc_id").agg(F.count("*").alias("tokens"), F.count_if("found").alias("found"), F.max("end").alias("last_end"))
