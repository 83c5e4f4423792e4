"""Votes of the rule tokenizers over whole texts: what `voting` gives for their tokens, made in the task that holds a text, so no token is shuffled or sorted by Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgraph.operators.cutting import CUTS, coded, cut, dealt_texts, in_rows, whole_documents
from inkgraph.operators.tokens import SURE, UNIVERSAL, form_tag

#: Processors in order of their names, and the confidences of their tokens.
NAMES = sorted(CUTS)
_SURE = [SURE[name] for name in NAMES]
#: Clusters of an island that are made for all islands at once.
ROUNDS = 16


def seed_clusters(start: np.ndarray, end: np.ndarray, iou: float) -> tuple[np.ndarray, np.ndarray]:
    """(island, number of the cluster in it) of spans in order, as `voting.cluster_tokens` has them.

    The first free span of each island is a seed and takes the free ones that overlap it by iou or more: one round for all islands at once. What
    is left after some rounds, as in a long run of marks, is gone through in order with the seeds that have not ended.
    """
    ahead = np.maximum.accumulate(end)
    island = np.cumsum(np.append(True, start[1:] >= ahead[:-1])) - 1
    number = np.zeros(len(start), np.int64)
    free = np.arange(len(start))
    for k in range(ROUNDS):
        head = np.append(True, island[free][1:] != island[free][:-1])
        seed = free[np.flatnonzero(head)[np.cumsum(head) - 1]]
        both = np.maximum(0, np.minimum(end[free], end[seed]) - np.maximum(start[free], start[seed]))
        mine = head | ((both > 0) & (both / np.maximum(np.maximum(end[free], end[seed]) - np.minimum(start[free], start[seed]), 1) >= iou))
        number[free[mine]] = k
        free = free[~mine]
        if not len(free):
            return island, number
    at, following, seeds = -1, 0, []
    for k, i, a, b in zip(free.tolist(), island[free].tolist(), start[free].tolist(), end[free].tolist(), strict=True):
        if i != at:
            at, following, seeds = i, ROUNDS, []
        seeds = [s for s in seeds if s[1] > a]
        found = next((s[2] for s in seeds if (min(b, s[1]) - a) / (max(b, s[1]) - s[0]) >= iou), None)
        if found is None:
            found = following
            seeds.append((a, b, following))
            following += 1
        number[k] = found
    return island, number


@dataclass
class _Spans:
    """Tokens of several documents in order of (document, start, end, processor), with their clusters."""

    ids: pa.Array
    row: np.ndarray  # place in ids
    start: np.ndarray
    end: np.ndarray
    processor: np.ndarray
    form: np.ndarray
    forms: list[str]
    part: np.ndarray
    parts: list[str]
    island: np.ndarray  # from 1 in each document
    number: np.ndarray
    cluster: np.ndarray  # rises with the order of documents and islands


def _clustered(ids: pa.Array, texts: list[str], iou: float) -> _Spans | None:
    cuts = [cut(texts, CUTS[name]) for name in NAMES]
    words = [w for c in cuts for w in c[0]]
    if not words:
        return None
    code, forms = coded(words)
    row = np.concatenate([np.repeat(np.arange(len(texts)), c[1]) for c in cuts])
    start, end = (np.concatenate([c[k] for c in cuts]) for k in (2, 3))
    processor = np.repeat(np.arange(len(NAMES)), [len(c[0]) for c in cuts])
    names = ids.to_pylist()
    doc = np.cumsum([k == 0 or names[k] != names[k - 1] for k in range(len(names))]) - 1
    # documents stand behind each other, so their spans never meet
    length = np.zeros(doc[-1] + 1, np.int64)
    np.maximum.at(length, doc, [len(t) for t in texts])
    base = (np.cumsum(length) - length)[doc][row]
    if doc[-1] + 1 == len(texts):
        order = np.lexsort((processor, end - start, start + base))
    else:  # a document of several rows can have two tokens of a processor at one place
        rank = np.empty(len(forms), np.int64)
        rank[sorted(range(len(forms)), key=forms.__getitem__)] = np.arange(len(forms))
        order = np.lexsort((rank[code], processor, end - start, start + base))
    row, start, end, processor, code, base = (x[order] for x in (row, start, end, processor, code, base))
    island, number = seed_clusters(start + base, end + base, iou)
    found = [UNIVERSAL.get(form_tag(x), "X") for x in forms]
    parts = sorted(set(found))
    part = np.array([parts.index(p) for p in found]).take(code)
    of = doc[row]
    head = np.append(True, of[1:] != of[:-1])
    before = island[np.flatnonzero(head)[np.cumsum(head) - 1]]
    return _Spans(ids, row, start, end, processor, code, forms, part, parts, island - before + 1, number, island * (number.max() + 1) + number)


def _heads(sorted_keys: np.ndarray) -> np.ndarray:
    return np.append(True, sorted_keys[1:] != sorted_keys[:-1])


def _counted(s: _Spans) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, part of speech, first token, tokens of each processor) of each cluster and part."""
    keys, first, at = np.unique(s.cluster * len(s.parts) + s.part, return_index=True, return_inverse=True)
    counts = np.bincount(at * len(NAMES) + s.processor, minlength=len(keys) * len(NAMES)).reshape(-1, len(NAMES))
    return keys // len(s.parts), keys % len(s.parts), first, counts


def _mean(counts: np.ndarray) -> np.ndarray:
    return sum(counts[:, k] * sure for k, sure in enumerate(_SURE)) / counts.sum(1)


def _named(s: _Spans, at: np.ndarray, part: np.ndarray) -> dict[str, pa.Array]:
    return {
        "doc_id": s.ids.take(pa.array(s.row[at])), "island": pa.array(s.island[at]), "number": pa.array(s.number[at]),
        "text": pa.array(s.forms, pa.string()).take(pa.array(s.form[at])), "pos": pa.array(s.parts, pa.string()).take(pa.array(part)),
    }


def _votes(s: _Spans, texts: list[str]) -> dict[str, pa.Array]:
    cluster, part, first, counts = _counted(s)
    votes, sure = (counts > 0).sum(1), _mean(counts)
    order = np.lexsort((part, -sure, -votes, cluster))
    best = order[_heads(cluster[order])]
    at = first[best]
    places = zip(s.row[at].tolist(), s.start[at].tolist(), s.end[at].tolist(), s.form[at].tolist(), strict=True)
    stands = [texts[r][a:b] == s.forms[f] for r, a, b, f in places]
    return _named(s, at, part[best]) | {"start": pa.array(s.start[at]), "end": pa.array(s.end[at]), "votes": pa.array(votes[best]), "confidence": pa.array(sure[best]), "stands": pa.array(stands, pa.bool_())}


def _merged(s: _Spans, texts: list[str]) -> dict[str, pa.Array]:
    cluster, part, first, counts = _counted(s)
    order = np.lexsort((part, -counts.sum(1), cluster))
    best = order[_heads(cluster[order])]
    begins = np.flatnonzero(_heads(cluster))
    all_counts, base = np.add.reduceat(counts, begins), np.minimum.reduceat(first, begins)
    held = ((all_counts > 0) << np.arange(len(NAMES))).sum(1)
    sources = [",".join(name for k, name in enumerate(NAMES) if bits >> k & 1) for bits in range(1 << len(NAMES))]
    return _named(s, base, part[best]) | {"confidence": pa.array(_mean(all_counts)), "sources": pa.array(sources, pa.string()).take(pa.array(held))}


def _in_texts(documents: DataFrame, made: Callable, more: str, iou: float) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in whole_documents(batches):
            spans = _clustered(ids, texts, iou)
            if spans is not None:
                yield from in_rows(made(spans, texts))

    kind = documents.schema["doc_id"].dataType.simpleString()
    found = dealt_texts(documents).mapInArrow(rows, f"doc_id {kind}, island long, number long, text string, pos string, {more}")
    return found.withColumn("cluster", F.concat_ws(".", "island", "number")).withColumn("confidence", F.round("confidence", 6))


def vote_texts(documents: DataFrame, min_agreement: int = 2, iou: float = 0.5) -> DataFrame:
    """`voting.vote_tokens` of the clustered tokens of all three tokenizers, and stands: whether the text has the token at its offsets."""
    found = _in_texts(documents, _votes, "start long, end long, votes long, confidence double, stands boolean", iou)
    return found.select("doc_id", "cluster", "start", "end", "text", "pos", "votes", "confidence", (F.col("votes") >= min_agreement).alias("agreed"), "stands")


def merge_texts(documents: DataFrame, iou: float = 0.5) -> DataFrame:
    """`voting.merge_tokens` of the clustered tokens of all three tokenizers."""
    return _in_texts(documents, _merged, "confidence double, sources string", iou).select("doc_id", "cluster", "text", "pos", "confidence", "sources")
