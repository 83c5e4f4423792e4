"""Vectorised byte and word helpers for Arrow string columns; numpy only, used inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that a vectorised step works on at once; a longer text is a step of its own.
STEP = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SYMBOL = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column in one array, and len + 1 offsets into it. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(offsets), np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, most: int = STEP) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most so many bytes, or one row."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = max(first + 1, min(last, rows))
        yield first, last
        first = last


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(n, STEP + 1).bit_length()
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[key] = np.multiply.accumulate(table)
    return _powers["up"][:n], _powers["down"][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer over 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """C with C[j] - C[i] times the inverse power at i: the hash of data[i:j], wherever it stands."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_SYMBOL[data] * powers(len(data))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [first, last)."""
    return mixed((prefix[last] - prefix[first]) * powers(len(prefix))[1][first] + (last - first).astype(np.uint64))


class Words:
    """The words of some texts: runs of bytes other than white space, A-Z lower-cased.

    first, last: byte spans. counts: words of each text. hashes: 64 bits of each word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, hashes: bool = True):
        self.low = low = data | ((data - np.uint8(65) < 26).view(np.uint8) << 5)  # arithmetic on bytes is faster than a look into LOWER and SPACE
        solid = (data != 32) & (data - np.uint8(9) > 4)
        n = len(data)
        before = np.zeros(n + 1, dtype=bool)
        before[1:] = solid
        after = np.zeros(n + 1, dtype=bool)
        after[:-1] = solid
        edges = offsets[(offsets > 0) & (offsets < n)]
        begin, end = after & ~before, before & ~after
        begin[edges] = after[edges]
        end[edges] = before[edges]
        self.first, self.last = np.flatnonzero(begin), np.flatnonzero(end)
        starts = np.searchsorted(self.first, offsets)
        self.starts = starts
        self.counts = np.diff(starts)
        if hashes:
            self.prefix = prefix_hash(low)
            self.hashes = span_hash(self.prefix, self.first, self.last)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


_PLACES = np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, first word) of every run of `size` words; of the whole sequence where a text has fewer."""
    h, counts, starts = words.hashes, words.counts, words.starts
    parts = []
    if len(h) >= size:
        owner = words.owner()
        at = np.flatnonzero(owner[: len(h) - size + 1] == owner[size - 1 :])
        total = np.zeros(len(at), dtype=np.uint64)
        for k in range(size):
            total += h[at + k] * _PLACES[k]
        parts.append((mixed(total), owner[at], at))
    for few in range(1, size):
        rows = np.flatnonzero(counts == few)
        if len(rows):
            total = np.full(len(rows), few, dtype=np.uint64)
            for k in range(few):
                total += h[starts[rows] + k] * _PLACES[k]
            parts.append((mixed(total), rows, starts[rows]))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    out = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    if len(parts) > 1:
        order = np.argsort(out[1], kind="stable")
        out = tuple(x[order] for x in out)
    return out


def distinct_per_text(values: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct values in ascending order, one after the other, and texts + 1 offsets."""
    ends = np.searchsorted(owner, np.arange(texts + 1))
    parts, sizes = [], np.zeros(texts + 1, dtype=np.int64)
    for k in range(texts):
        part = values[ends[k] : ends[k + 1]]
        if len(part) > 1:
            part = np.sort(part)
            part = part[np.concatenate(([True], part[1:] != part[:-1]))]
        sizes[k + 1] = len(part)
        parts.append(part)
    return (np.concatenate(parts) if parts else np.zeros(0, values.dtype)), np.cumsum(sizes)


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, type=kind))
