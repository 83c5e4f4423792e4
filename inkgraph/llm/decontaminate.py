"""Benchmark decontamination: SimHash windows as long as the items, a multi-index over Hamming blocks, exact checks.

For every item the windows of a text with as many shingles are candidates. A window and an item of
similarity t share at least t / (1 + t) of their shingles together; windows with fewer shingles of any
item are passed over, which loses nothing. The others get a 64-bit SimHash. It is looked up in eight
blocks of eight bits: fingerprints within RADIUS bits agree in one block up to RADIUS // 8 bits, so the
lookup finds all of them. What it finds is compared shingle by shingle, each weighted by its count.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgraph.llm import bytes as by
from inkgraph.llm.common import small_batches

#: Hamming distance that the index guarantees. Two sets of similarity 0.8 are about 10 bits apart, with a deviation of 3.
RADIUS = 22
#: Items of one index and the bytes of their texts, about. A larger benchmark is gone through in blocks of as many.
ITEMS, ITEM_BYTES = 20_000, 1 << 24
#: Bytes that the windows of one run take, about.
RUN_BYTES = 1 << 26
_BLOCKS = 8


@dataclass
class Index:
    ids: list
    sizes: np.ndarray  # shingles of each item
    bags: list[dict[int, int]]
    prints: np.ndarray
    near: np.ndarray  # block x value x packed items within RADIUS // 8 bits
    known: np.ndarray  # sorted shingles of all items
    mask: np.ndarray  # of their upper 20 bits
    short: dict[int, dict[int, list[int]]]  # words of an item under the shingle size -> hash -> items


def simhash(hashes: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of the rows of a windows x shingles array."""
    bits = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(*hashes.shape, 8), axis=2)
    return np.packbits(2 * bits.sum(axis=1, dtype=np.int32) > hashes.shape[1], axis=1).view(np.uint64).ravel()


def build(items: list[tuple], size: int) -> Index:
    """From (id, text). Items without words are left out."""
    data, offsets = by.flat(pa.array([t for _, t in items], type=pa.string()))
    words = by.Words(data, offsets)
    hashes, owner, _ = by.shingles(words, size)
    ends = np.searchsorted(owner, np.arange(len(items) + 1))
    kept, bags, prints, short = [], [], [], {}
    for k in range(len(items)):
        own = hashes[ends[k] : ends[k + 1]]
        if not len(own):
            continue
        if words.counts[k] < size:
            short.setdefault(int(words.counts[k]), {}).setdefault(int(own[0]), []).append(len(kept))
        kept.append(k)
        bags.append(dict(Counter(own.tolist())))
        prints.append(simhash(own[None])[0])
    prints_ = np.array(prints, dtype=np.uint64)
    blocks = prints_.view(np.uint8).reshape(-1, _BLOCKS)
    distance = np.bitwise_count(blocks.T[:, None, :] ^ np.arange(256, dtype=np.uint8)[None, :, None])
    near = np.packbits(distance <= RADIUS // _BLOCKS, axis=2)
    known = np.unique(hashes)
    mask = np.zeros(1 << 20, dtype=bool)
    mask[(known >> np.uint64(44)).astype(np.int64)] = True
    sizes = np.array([0 if words.counts[k] < size else sum(b.values()) for k, b in zip(kept, bags, strict=True)], dtype=np.int64)
    return Index([items[k][0] for k in kept], sizes, bags, prints_, near, known, mask, short)


def _least(window: int, item: int, percent: int) -> int:
    """Shingles that a window must share with an item to reach the similarity."""
    return -(-percent * (window + item) // (100 + percent))


def similarity(bag: dict[int, int], window: list[int]) -> float:
    """Sum of the smaller counts over the sum of the larger ones."""
    other = Counter(window)
    both = sum(min(n, other[k]) for k, n in bag.items() if k in other)
    return both / (sum(bag.values()) + len(window) - both)


def leaks(index: Index, column: pa.Array, size: int, percent: int) -> dict[tuple[int, int], tuple[float, int]]:
    """(row, item) -> best similarity and the window's first word, for all that reach percent / 100."""
    found: dict[tuple[int, int], tuple[float, int]] = {}
    if not len(index.ids):
        return found

    def keep(row: int, item: int, value: float, word: int) -> None:
        if (row, item) not in found or value > found[row, item][0]:
            found[row, item] = (value, word)

    lengths = sorted({int(s) for s in index.sizes if s})
    data, offsets = by.flat(column)
    for first, last in by.steps(offsets):
        part = offsets[first : last + 1]
        words = by.Words(data[part[0] : part[-1]], part - part[0])
        for few, by_hash in index.short.items():
            _short(words, few, by_hash, first, keep)
        hashes, owner, _ = by.shingles(words, size)
        hit = index.mask[(hashes >> np.uint64(44)).astype(np.int64)]
        at = np.flatnonzero(hit)
        if not len(at) or not lengths:
            continue
        place = np.minimum(np.searchsorted(index.known, hashes[at]), len(index.known) - 1)
        hit[at] = index.known[place] == hashes[at]
        running = np.concatenate(([0], np.cumsum(hit)))
        ends = np.searchsorted(owner, np.arange(last - first + 1))
        per_text = running[ends[1:]] - running[ends[:-1]]
        for row in np.flatnonzero(per_text >= _least(1, 1, percent)):
            a, b = int(ends[row]), int(ends[row + 1])
            if words.counts[row] < size:
                continue  # equal to a short item or to none
            for length in lengths:
                wide = min(length, b - a)
                need = _least(wide, length, percent)
                if per_text[row] < need:
                    continue
                starts = np.arange(a, b - wide + 1)
                starts = starts[running[starts + wide] - running[starts] >= need]
                if not len(starts):
                    continue
                run = max(1, RUN_BYTES // max(64 * wide, len(index.ids)))  # a long text goes through in runs of windows
                for begin in range(0, len(starts), run):
                    _verify(index, hashes, starts[begin : begin + run], wide, length, percent, lambda k, value, start: keep(first + int(row), k, value, int(start - a)))
    return found


def _verify(index: Index, hashes: np.ndarray, starts: np.ndarray, wide: int, length: int, percent: int, keep) -> None:
    """Fingerprints of windows, the items within the radius by blocks, and the exact similarity of each such pair."""
    windows = hashes[starts[:, None] + np.arange(wide)]
    prints = simhash(windows)
    parts = prints.view(np.uint8).reshape(-1, _BLOCKS)
    some = index.near[0, parts[:, 0]]
    for block in range(1, _BLOCKS):
        some = some | index.near[block, parts[:, block]]
    at_window, item = np.nonzero(np.unpackbits(some, axis=1, count=len(index.ids)))
    close = (index.sizes[item] == length) & (np.bitwise_count(index.prints[item] ^ prints[at_window]) <= RADIUS)
    for w, k in zip(at_window[close].tolist(), item[close].tolist(), strict=True):
        value = similarity(index.bags[k], windows[w].tolist())
        if 100 * value >= percent - 1e-9:
            keep(k, value, starts[w])


def _short(words: by.Words, few: int, by_hash: dict[int, list[int]], first: int, keep) -> None:
    """Items of fewer words than a shingle: the same words in a row."""
    n = len(words.hashes) - few + 1
    if n <= 0:
        return
    owner = words.owner()
    at = np.flatnonzero(owner[:n] == owner[few - 1 :])
    total = np.full(len(at), few, dtype=np.uint64)
    for k in range(few):
        total += words.hashes[at + k] * by._PLACES[k]
    total = by.mixed(total)
    for w in np.flatnonzero(np.isin(total, np.array(list(by_hash), dtype=np.uint64))):
        row = int(owner[at[w]])
        for item in by_hash[int(total[w])]:
            keep(first + row, item, 1.0, int(at[w] - words.starts[row]))


def indexes(benchmark: DataFrame, size: int) -> Iterator[Index]:
    """Indexes over blocks of at most about ITEMS items and ITEM_BYTES bytes; the benchmark is the fixed side, its blocks are what is sent to the executors."""
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    n, size_of = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // ITEMS), -(-size_of // ITEM_BYTES))
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        yield build(sorted(((r[0], r[1]) for r in rows), key=str), size)


def _found(batches: Iterator[pa.RecordBatch], index: Index, size: int, percent: int, names: list[str], item_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits = sorted(leaks(index, batch.column(1), size, percent).items())
        if hits:
            ids = batch.column(0).take(pa.array([row for (row, _), _ in hits]))
            yield pa.RecordBatch.from_arrays([ids, pa.array([index.ids[k] for (_, k), _ in hits], type=item_type), pa.array([round(v, 9) for _, (v, _) in hits]), pa.array([w for _, (_, w) in hits], type=pa.int64())], names=names)


def find_leaks(documents: DataFrame, benchmark: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, similarity, first_word): the best window of each text for each item that it holds at percent / 100 or more.

    Words are runs of bytes other than white space, A-Z lower-cased. A text shorter than an item is
    one window; an item of fewer than `size` words is found where the same words stand in a row. Texts
    and items that are null or have no words match nothing; null ids stay null. Repeated rows are
    reported each for itself. Other columns are not read. No documents or no items: no rows.
    """
    spark = documents.sparkSession
    small_batches(spark)
    kinds = [documents.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()]
    item_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kinds[1]]
    rows = documents.select("doc_id", F.col("text").cast("string").alias("_text"))
    names = ["doc_id", "item_id", "similarity", "first_word"]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, similarity double, first_word long"

    def one(index: Index) -> DataFrame:
        shared = spark.sparkContext.broadcast(index)
        return rows.mapInArrow(lambda it: _found(it, shared.value, size, percent, names, item_type), schema)

    return reduce(DataFrame.unionByName, [one(x) for x in indexes(benchmark, size)])


def _clean(batches: Iterator[pa.RecordBatch], index: Index, size: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.ones(batch.num_rows, dtype=bool)
        for row, _ in leaks(index, batch.column(batch.schema.get_field_index("text")), size, percent):
            keep[row] = False
        yield batch.filter(pa.array(keep))


def without_leaks(documents: DataFrame, benchmark: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of documents, all columns, in which find_leaks finds no item."""
    spark = documents.sparkSession
    small_batches(spark)
    for index in indexes(benchmark, size):
        shared = spark.sparkContext.broadcast(index)
        documents = documents.mapInArrow(lambda it, shared=shared: _clean(it, shared.value, size, percent), documents.schema)
    return documents
