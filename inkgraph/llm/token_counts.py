"""Token counts of whole texts with a public tokenizer, batch by batch in Arrow functions."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkgraph.llm import bytes as by
from inkgraph.llm.common import small_batches

SCHEMA = "n_bytes long, n_tokens long, over_limit boolean"
#: Stands for a piece beside which a text can't be cut; far below any sum of counts.
_JOINED = -(1 << 50)


class Encoder:
    """Counts the tokens of many strings at once; kept for as long as the Python worker lives.

    known: counts of pieces " word" met before. It is emptied when it holds most_known pieces.
    """

    def __init__(self, path: str, most_known: int = 400_000, longest_known: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has one task for each core
        self.known: dict[str, int] = {}
        self.most_known, self.longest_known = most_known, longest_known
        self.cuttable = False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._lengths: Callable = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            return
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.no_truncation()
        model.no_padding()
        self._lengths = lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        before = own.get("pre_tokenizer") or {}
        plain = all(" " not in x["content"] and not x["lstrip"] and not x["rstrip"] for x in own.get("added_tokens", ()))
        self.cuttable = plain and own.get("normalizer") is None and before.get("type") == "ByteLevel" and bool(before.get("use_regex", True)) and not before.get("add_prefix_space")

    def lengths(self, texts: list[str], batch_bytes: int) -> list[int]:
        """Token counts, encoded in batches of about as many bytes each."""
        out, first, size = [], 0, 0
        for k, text in enumerate(texts):
            size += len(text)
            if size >= batch_bytes or k == len(texts) - 1:
                out += self._lengths(texts[first : k + 1])
                first, size = k + 1, 0
        return out

    def counts(self, texts: list[str], batch_bytes: int) -> list[int]:
        if not self.cuttable:
            return self.lengths(texts, batch_bytes)
        split = [text.split(" ") for text in texts]
        new = {part for parts in split for part in parts[1:]}.difference(self.known)
        if len(self.known) + len(new) > self.most_known:
            self.known.clear()
            new = {part for parts in split for part in parts[1:]}
        known = {x: _JOINED for x in new if not _edges(x)}
        fresh = [x for x in new if x not in known]
        known |= zip(fresh, self.lengths([" " + x for x in fresh], batch_bytes), strict=True)
        self.known |= {k: n for k, n in known.items() if len(k) <= self.longest_known}
        rest: list[str] = []
        owner: list[int] = []
        totals = [0] * len(texts)
        for row, parts in enumerate(split):
            try:
                total = sum(map(self.known.__getitem__, parts[1:]))
            except KeyError:
                total = sum(known[x] if x in known else self.known[x] for x in parts[1:])
            if total >= 0 and (len(parts) == 1 or _edges(parts[0])):
                rest.append(parts[0])
                owner.append(row)
                totals[row] = total
            else:
                joined = _joined(parts)
                rest += joined
                owner += [row] * len(joined)
        for row, n in zip(owner, self.lengths(rest, batch_bytes), strict=True):
            totals[row] += n
        return totals


def _edges(part: str) -> bool:
    """A text may be cut before the space in front of the part and behind the part."""
    return bool(part) and ("!" <= part[0] <= "~" or part[0].isalnum()) and ("!" <= part[-1] <= "~" or part[-1].isalnum())


def _joined(parts: list[str]) -> list[str]:
    """The text in pieces again, cut before single spaces with a letter, digit or ASCII sign on both sides."""
    out, open_ = [parts[0]], not _edges(parts[0])
    for part in parts[1:]:
        good = _edges(part)
        if open_ or not good:
            out[-1] += " " + part
        else:
            out.append(" " + part)
        open_ = not good
    return out


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _counted(batches: Iterator[pa.RecordBatch], path: str, limit: int, batch_bytes: int) -> Iterator[pa.RecordBatch]:
    model = encoder(path)
    for batch in batches:
        ids, column = batch.column(0), batch.column(1)
        _, offsets = by.flat(column)
        counts: list[int] = []
        for first, last in by.steps(offsets, batch_bytes):
            counts += model.counts([x or "" for x in column.slice(first, last - first).to_pylist()], batch_bytes)
        n_tokens = np.array(counts, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(offsets)), pa.array(n_tokens), pa.array(n_tokens > limit)], names=[batch.schema.names[0], "n_bytes", "n_tokens", "over_limit"])


def count_tokens(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, batch_bytes: int = 1 << 19) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each row, one row out for each row in.

    vocabulary: path of a .json (tokenizers) or .model (sentencepiece) file on the executors. No begin,
    end or added special tokens; special strings inside texts as the library takes them by default.
    Only lengths leave the Python workers. Texts go to the library in batches of about batch_bytes.

    Texts for a byte-level model are cut at safe boundaries first: before a single space with a
    letter, digit or ASCII sign on both sides. Its pre-tokenizer always ends a word there and begins
    the next with the space, so counts add up; a piece that was met before isn't encoded again.
    Other models get whole texts.

    Null text: 0 bytes and 0 tokens. A null id stays null. Repeated rows are counted each for itself.
    Other columns of df, whatever their names, are not read. An empty table gives an empty result.
    """
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, df[text_col].cast("string").alias("_text")).mapInArrow(lambda it: _counted(it, vocabulary, limit, batch_bytes), f"`{id_col}` {kind}, {SCHEMA}")
