"""Quality classifier: a byte-level convolutional network in numpy over chunks that cover the whole text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgraph.llm import bytes as by
from inkgraph.llm.common import fold, labelled_sample, small_batches

#: Bytes of a chunk, of a filter, and between two places of a filter; size of a byte's vector; filters.
CHUNK, WIDTH, STRIDE, DIM, FILTERS = 256, 8, 2, 8, 24
PLACES = CHUNK // STRIDE
#: Chunks whose filter responses are held at once.
RUN_CHUNKS = 1024
_TAPS = WIDTH // STRIDE


@dataclass
class Network:
    """embed: vectors of bytes, the last of the padding; filters, bias; out: weights of maxima and of mean maxima."""

    embed: np.ndarray  # 257 x DIM
    filters: np.ndarray  # _TAPS x (STRIDE * DIM) x FILTERS
    bias: np.ndarray
    out: np.ndarray  # 2 * FILTERS
    shift: float

    def arrays(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.out]


def fresh(seed: int) -> Network:
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.5, (257, DIM)).astype(np.float32)
    code = np.arange(256)
    for k, kind in enumerate([(code >= 65) & (code < 91), (code >= 97) & (code < 123), (code >= 48) & (code < 58), by.SPACE, (code > 32) & (code < 127) & ~np.isin(code, [*range(48, 58), *range(65, 91), *range(97, 123)]), code > 127]):
        embed[:256, k] += 1.5 * kind
    embed[256] = 0
    return Network(embed, rng.normal(0, 0.15, (_TAPS, STRIDE * DIM, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), 1.0)


def chunked(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (a byte, or 256 for padding) with every text filled up to whole chunks, and chunks of each text.

    A text is followed by at least a filter's width of padding, and a filter that begins in one
    chunk reads on into the next, so chunks overlap and no place of a text is left out.
    """
    lengths = np.diff(offsets)
    chunks = np.maximum(1, -(-(lengths + WIDTH) // CHUNK))
    begin = np.concatenate(([0], np.cumsum(chunks * CHUNK)))
    codes = np.full(begin[-1] + WIDTH, 256, dtype=np.int16)
    shift = np.repeat(begin[:-1] - offsets[:-1], lengths)
    codes[np.arange(len(data)) + shift] = data
    return codes, chunks


def responses(net: Network, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Filter responses before the bias: chunks x places x filters.

    ends: the last chunks of texts. Their last places begin in padding and reach into the next text, so they count as nothing.
    """
    rows = net.embed.take(codes, axis=0).reshape(-1, STRIDE * DIM)
    n = (len(codes) - WIDTH) // STRIDE
    total = rows[:n] @ net.filters[0]
    for k in range(1, _TAPS):
        total += rows[k : n + k] @ net.filters[k]
    total = total.reshape(-1, PLACES, FILTERS)
    total[ends, PLACES - _TAPS + 1 :] = -1e30
    return total


def pooled(top: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    """Of each text the maximum over its chunks and the mean of its chunks' maxima."""
    ends = np.concatenate(([0], np.cumsum(chunks)[:-1]))
    return np.concatenate([np.maximum.reduceat(top, ends), np.add.reduceat(top, ends) / chunks[:, None]], axis=1)


def strongest(net: Network, codes: np.ndarray, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, response with bias) of each filter's maximum in each chunk. Texts go through in runs of chunks, so that a very long one needs little memory."""
    where, best, ends = [], [], np.cumsum(chunks) - 1
    for at in range(0, int(chunks.sum()), RUN_CHUNKS):
        run = codes[at * CHUNK : min(len(codes), (at + RUN_CHUNKS) * CHUNK + WIDTH)]
        raw = responses(net, run, ends[(ends >= at) & (ends < at + RUN_CHUNKS)] - at)
        place = raw.argmax(axis=1)
        where.append(place)
        best.append(np.take_along_axis(raw, place[:, None], axis=1)[:, 0] + net.bias)
    return np.concatenate(where), np.concatenate(best)


def probabilities(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.zeros(len(offsets) - 1)
    for first, last in by.steps(offsets):
        part = offsets[first : last + 1]
        codes, chunks = chunked(data[part[0] : part[-1]], part - part[0])
        tops, ends = [], np.cumsum(chunks) - 1
        for at in range(0, int(chunks.sum()), RUN_CHUNKS):
            run = codes[at * CHUNK : min(len(codes), (at + RUN_CHUNKS) * CHUNK + WIDTH)]
            tops.append(np.maximum(responses(net, run, ends[(ends >= at) & (ends < at + RUN_CHUNKS)] - at).max(axis=1) + net.bias, 0))
        z = pooled(np.concatenate(tops), chunks) @ net.out + net.shift
        out[first:last] = 1 / (1 + np.exp(-np.clip(z, -30, 30).astype(np.float64)))
    return out


def _batches(lengths: np.ndarray, order: np.ndarray, most_texts: int, most_bytes: int = 1 << 18) -> Iterator[np.ndarray]:
    """Texts in the given order, in batches of so many texts and bytes, or one text."""
    first, size = 0, 0
    for k, n in enumerate(lengths[order].tolist()):
        if k > first and (k - first == most_texts or size + n > most_bytes):
            yield order[first:k]
            first, size = k, 0
        size += n
    if len(order):
        yield order[first:]


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 11, epochs: int = 8, batch: int = 32, rate: float = 0.01) -> Network:
    """Adam on the log loss; gradients reach a filter at its maximum in each chunk."""
    net = fresh(seed)
    if len(set(labels.tolist())) < 2:
        net.out[:] = 0
        net.shift = 3.0 if len(labels) == 0 or labels[0] == 1 else -3.0
        return net
    rng = np.random.default_rng(seed)
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in [*net.arrays(), np.zeros(1, np.float32)]]
    shift = np.array([net.shift], dtype=np.float32)
    epochs = max(epochs, min(30, -(-300 * batch // len(texts))))  # a small sample is passed more often
    lengths = np.array([len(x) for x in texts])
    orders = [rng.permutation(len(texts)) for _ in range(epochs)]
    step, total = 0, sum(1 for order in orders for _ in _batches(lengths, order, batch))
    for order in orders:
        for rows in _batches(lengths, order, batch):
            joined = [texts[k] for k in rows]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in joined])))
            codes, chunks = chunked(np.frombuffer(b"".join(joined), np.uint8), offsets)
            where, best = strongest(net, codes, chunks)
            top = np.maximum(best, 0)
            features = pooled(top, chunks)
            p = 1 / (1 + np.exp(-np.clip(features @ net.out + shift[0], -30, 30)))
            g = ((p - labels[rows]) / len(rows)).astype(np.float32)
            to_features = g[:, None] * net.out
            owner = np.repeat(np.arange(len(rows)), chunks)
            is_top = top >= features[owner, :FILTERS] - 1e-12
            to_top = to_features[owner, FILTERS:] / chunks[owner][:, None] + to_features[owner, :FILTERS] * is_top
            to_top = (to_top * (best > 0)).astype(np.float32)
            first = (np.arange(len(where))[:, None] * CHUNK + where * STRIDE).ravel()
            flat = net.filters.reshape(WIDTH * DIM, FILTERS).T
            to_filters, to_embed = np.zeros((WIDTH * DIM, FILTERS), np.float32), np.zeros((257, DIM), np.float32)
            for a in range(0, len(where), RUN_CHUNKS):
                own = to_top[a : a + RUN_CHUNKS]
                windows = codes[first[a * FILTERS : (a + RUN_CHUNKS) * FILTERS, None] + np.arange(WIDTH)]  # (chunks * FILTERS) x WIDTH
                vectors = net.embed[windows].reshape(len(own), FILTERS, WIDTH * DIM)
                to_filters += np.einsum("cf,cfd->df", own, vectors, optimize=True)
                to_vectors = (own.ravel()[:, None] * np.tile(flat, (len(own), 1))).reshape(-1, DIM)
                to_embed += np.stack([np.bincount(windows.ravel(), to_vectors[:, d], minlength=257) for d in range(DIM)], axis=1).astype(np.float32)
            to_filters = to_filters.reshape(_TAPS, STRIDE * DIM, FILTERS)
            to_embed[256] = 0
            grads = [to_embed, to_filters, to_top.sum(axis=0), features.T @ g + 1e-4 * net.out, np.array([g.sum()], np.float32)]
            step += 1
            pace = rate * min(1.0, 2.0 * (1 - step / (total + 1)))
            for x, (m, v), d in zip([*net.arrays(), shift], state, grads, strict=True):
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                x -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    net.shift = float(shift[0])
    return net


def train(documents: DataFrame, labels: DataFrame, folds: int = 5, most_per_class: int = 1500, seed: int = 11) -> Network:
    """Learn labels.quality from a bounded sample outside fold 0: at most most_per_class documents of either label, their whole texts.

    The driver holds these texts; the two classes weigh alike in the sample.
    """
    small_batches(documents.sparkSession)
    sample = labelled_sample(documents, labels, "quality", folds, (most_per_class, most_per_class)).select(F.col("text").cast("binary"), "label").toArrow()
    rows = sorted(zip(sample.column(0).to_pylist(), sample.column(1).to_pylist(), strict=True))
    rng = np.random.default_rng(seed)
    for raw, label in list(rows):  # good texts stay good when they are short; few of the rows are
        if label == 1 and len(raw) > 200 and rng.random() < 0.25:
            at = raw.find(b" ", int(rng.integers(0, len(raw) - 160))) + 1
            rows.append((raw[at : at + int(rng.integers(20, 140))].strip(), 1))
    return fit([r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.float32), seed)


def _scored(batches: Iterator[pa.RecordBatch], net: Network, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score = probabilities(net, *by.flat(batch.column(0)))
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*batch.schema.names[1:], "score", "predicted"])


def score_quality(documents: DataFrame, net: Network, threshold: float = 0.3, folds: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row: the probability that its quality label is 1.

    The whole text counts; null and empty texts get the score of padding alone. Repeated rows are
    scored alike, a null doc_id stays null. Other columns are not read. No documents: no rows.
    """
    small_batches(documents.sparkSession)
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select(F.col("text").cast("string").alias("_text"), "doc_id", (fold("doc_id", folds) == 0).alias("held_out"))
    return rows.mapInArrow(lambda it: _scored(it, net, threshold), f"doc_id {kind}, held_out boolean, score double, predicted int")


def _kept(batches: Iterator[pa.RecordBatch], net: Network, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score = probabilities(net, *by.flat(batch.column(batch.schema.get_field_index("text"))))
        yield batch.filter(pa.array(score >= threshold))


def keep_good(documents: DataFrame, net: Network, threshold: float = 0.3) -> DataFrame:
    """The rows of documents, all columns, whose quality score reaches the threshold."""
    small_batches(documents.sparkSession)
    return documents.mapInArrow(lambda it: _kept(it, net, threshold), documents.schema)
