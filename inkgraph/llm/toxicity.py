"""Toxicity: character n-gram embeddings of words, averaged into a linear softmax, trained jointly in numpy.

A window of words is a bag of the n-grams of its words, so a misspelling shares most vectors with the
word it comes from. The softmax of two classes over an average of vectors needs only the difference u
of its weight rows: a window's log odds are the mean of (vector . u) over its n-grams, plus a bias. So
once trained, every n-gram has one number, and a text is scored by sums of such numbers. Windows of a
few words overlap and cover the whole text; a text is as toxic as its worst window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgraph.llm import bytes as by
from inkgraph.llm.common import fold, labelled_sample, small_batches

#: Hash buckets (a power of two), size of vectors, lengths of n-grams in bytes, words of a window and between windows.
BUCKETS, DIM, GRAMS, WINDOW, HOP = 1 << 16, 12, (3, 4, 5), 6, 3
_SHIFT = np.uint64(64 - 16)
#: Words whose n-grams are made at once.
RUN_WORDS = 50_000


@dataclass
class Model:
    """value: log odds that an n-gram adds to its window's mean; bias: those of an empty window."""

    value: np.ndarray
    bias: float


def grams(words: by.Words, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of every n-gram and every whole word of the words from begin to end; an n-gram may hold one space before or behind its word."""
    first, last = words.first[begin:end], words.last[begin:end]
    if not len(first):
        return np.zeros(0, np.uint16), np.zeros(0, np.int64)
    length = last - first
    buckets, owners = [(words.hashes[begin:end] >> _SHIFT).astype(np.uint16)], [np.arange(len(length))]
    # each word with one space byte on either side, laid end to end
    start = np.concatenate(([0], np.cumsum(length + 2)))
    padded = np.full(start[-1], 32, dtype=np.uint8)
    inside = np.repeat(start[:-1] + 1 - first, length)
    places = np.repeat(first - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(length.sum())
    padded[places + inside] = words.low[places]
    prefix = by.prefix_hash(padded)
    owner = np.repeat(np.arange(len(length)), length + 2)
    stop = start[1:][owner]
    at = np.arange(len(padded))
    for n in GRAMS:
        here = at[at + n <= stop]
        buckets.append((by.span_hash(prefix, here, here + n) >> _SHIFT).astype(np.uint16))
        owners.append(owner[here])
    return np.concatenate(buckets), np.concatenate(owners)


def windows(words: by.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, word behind the last, text) of windows that cover every text; a text without words has none."""
    counts = words.counts
    each = np.where(counts > 0, np.maximum(1, -(-(counts - WINDOW) // HOP) + 1), 0)
    text = np.repeat(np.arange(len(counts)), each)
    number = np.arange(each.sum()) - np.repeat(np.concatenate(([0], np.cumsum(each)[:-1])), each)
    first = words.starts[:-1][text] + number * HOP
    return first, np.minimum(first + WINDOW, words.starts[1:][text]), text


def _window_means(values: np.ndarray, counts: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means over windows, from sums and counts of their words."""
    total = np.concatenate(([0.0], np.cumsum(values)))
    count = np.concatenate(([0.0], np.cumsum(counts)))
    size = count[last] - count[first]
    return (total[last] - total[first]) / np.maximum(size, 1), size


def probabilities(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each text the probability of its most toxic window; of an empty window where a text has no words."""
    out = np.full(len(offsets) - 1, model.bias, dtype=np.float64)
    for begin, end in by.steps(offsets):
        part = offsets[begin : end + 1]
        words = by.Words(data[part[0] : part[-1]], part - part[0])
        n = len(words.first)
        if not n:
            continue
        values, counts = np.zeros(n), np.zeros(n)
        for a in range(0, n, RUN_WORDS):  # a very long text goes through in runs of words
            b = min(n, a + RUN_WORDS)
            bucket, owner = grams(words, a, b)
            values[a:b], counts[a:b] = np.bincount(owner, model.value[bucket], minlength=b - a), np.bincount(owner, minlength=b - a)
        first, last, text = windows(words)
        mean, _ = _window_means(values, counts, first, last)
        best = np.full(end - begin, -np.inf)
        np.maximum.at(best, text, mean)
        out[begin:end] = np.where(np.isfinite(best), best + model.bias, model.bias)
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 5, epochs: int = 10, batch: int = 100, rate: float = 0.05, decay: float = 1e-5) -> Model:
    """Vectors, softmax and bias are learnt together, with Adam; a text's gradient goes to its worst windows.

    In the first epochs it goes to the worst third and then tenth of a toxic text's windows, before the
    vectors know which those are. Toxic texts, of which the sample has fewer, weigh twice as much.
    """
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 3.0 if len(labels) and labels[0] == 1 else -3.0)
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    u, bias = rng.normal(0, 0.3, DIM).astype(np.float32), np.array([-1.0], np.float32)
    prepared, batch = [], max(12, min(batch, len(texts) // 30))
    order = np.argsort(rng.random(len(texts)), kind="stable")
    for at in range(0, len(order), batch):
        rows = order[at : at + batch]
        offsets = np.concatenate(([0], np.cumsum([len(texts[k]) for k in rows])))
        words = by.Words(np.frombuffer(b"".join(texts[k] for k in rows), np.uint8), offsets)
        buckets, sizes = [], []
        for a in range(0, len(words.first), RUN_WORDS):
            bucket, owner = grams(words, a, min(len(words.first), a + RUN_WORDS))
            buckets.append(bucket[np.argsort(owner, kind="stable")])
            sizes.append(np.bincount(owner))
        each = np.concatenate([np.zeros(0, np.int64), *sizes]).astype(np.int32)
        prepared.append((rows, np.concatenate([np.zeros(0, np.uint16), *buckets]), each, *(x.astype(np.int32) for x in windows(words))))
    epochs = max(epochs, min(20, -(-400 // len(prepared))))  # a small sample is passed more often
    moment = [(np.zeros_like(x), np.zeros_like(x)) for x in (vectors, u, bias)]
    step, steps = 0, epochs * len(prepared)
    for epoch in range(epochs):
        for rows, bucket, each, first, last, text in prepared:
            if not len(first):
                continue
            n = len(each)
            owner = np.repeat(np.arange(n), each)
            value = vectors @ u
            mean, size = _window_means(np.bincount(owner, value[bucket], minlength=n), each, first, last)
            z = np.clip(mean + bias[0], -30, 30)
            p = 1 / (1 + np.exp(-z))
            y = labels[rows][text]
            rank = np.lexsort((-z, text))
            start = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(rows)))))
            place = np.empty(len(text), dtype=np.int64)
            place[rank] = np.arange(len(text)) - start[text[rank]]
            many = (start[1:] - start[:-1])[text]
            keep = np.where(y > 0, np.maximum(np.minimum(2, many), many // (3 if epoch < 2 else 10 if epoch < 4 else 10**9)), np.maximum(1, many // (3 if epoch < 4 else 12)))
            chosen = place < keep
            g = np.where(chosen, (p - y) / keep, 0) * np.where(y > 0, 2.0, 1.0) / len(rows)
            # each window hands its share to its n-grams: by word, through running sums
            share = g / np.maximum(size, 1)
            line = np.zeros(n + 1)
            np.add.at(line, first, share)
            np.add.at(line, last, -share)
            weight = np.bincount(bucket, np.cumsum(line)[:n][owner], minlength=BUCKETS).astype(np.float32)
            touched = np.flatnonzero(weight)
            step += 1
            pace = rate * (1 - step / (steps + 1))
            scale = 10.0  # means over a window's n-grams make small gradients
            grads = (weight[touched, None] * u * scale + decay * vectors[touched], weight[touched] @ vectors[touched], np.array([g.sum()]))
            for k, (x, (m, v), d) in enumerate(zip((vectors, u, bias), moment, grads, strict=True)):
                at = touched if k == 0 else slice(None)
                m[at] += 0.1 * (d - m[at])
                v[at] += 0.01 * (d * d - v[at])
                x[at] -= (pace * m[at] / (np.sqrt(v[at]) + 1e-8)).astype(np.float32)
    return Model((vectors @ u).astype(np.float32), float(bias[0]))


def train(documents: DataFrame, labels: DataFrame, folds: int = 5, most: tuple[int, int] = (2500, 1200), seed: int = 5) -> Model:
    """Learn labels.toxic from a bounded sample outside fold 0: so many documents labelled 0 and so many labelled 1, their whole texts.

    The driver holds these texts and two bytes for each of their n-grams.
    """
    small_batches(documents.sparkSession)
    sample = labelled_sample(documents, labels, "toxic", folds, most).select(F.col("text").cast("binary"), "label").toArrow()
    rows = sorted(zip(sample.column(0).to_pylist(), sample.column(1).to_pylist(), strict=True))
    del sample
    return fit([r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.float32), seed)


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score = probabilities(model, *by.flat(batch.column(0)))
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*batch.schema.names[1:], "score", "predicted"])


def score_toxicity(documents: DataFrame, model: Model, folds: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row: the probability that its toxic label is 1.

    The whole text counts. Null, empty and blank texts have the score of an empty window. Repeated rows
    are scored alike, a null doc_id stays null. Other columns are not read. No documents: no rows.
    """
    spark = documents.sparkSession
    small_batches(spark)
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select(F.col("text").cast("string").alias("_text"), "doc_id", (fold("doc_id", folds) == 0).alias("held_out"))
    return rows.mapInArrow(lambda it: _scored(it, model), f"doc_id {kind}, held_out boolean, score double, predicted int")


def _kept(batches: Iterator[pa.RecordBatch], model: Model, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score = probabilities(model, *by.flat(batch.column(batch.schema.get_field_index("text"))))
        yield batch.filter(pa.array(score < threshold))


def keep_civil(documents: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of documents, all columns, whose toxicity score stays under the threshold."""
    small_batches(documents.sparkSession)
    return documents.mapInArrow(lambda it: _kept(it, model, threshold), documents.schema)
