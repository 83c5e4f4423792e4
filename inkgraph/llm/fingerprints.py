"""Document fingerprints: invertible Bloom lookup sketches over paragraph digests."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from inkgraph.llm.bytes import mixed
from inkgraph.llm.common import small_batches

#: Cells of a stored fingerprint, in three sub-tables.
CELLS = 24
_CHECK = np.uint64(0xA5A5F00D12345677)
_LOW = np.uint64(0xFFFFFFFF)  # checks are kept in 32 bits
_SENTENCE = re.compile(r"(?<=[.!?]) ")


def paragraphs(text: str, long: int = 160) -> list[str]:
    """The lines of a text; long lines in sentences, and long sentences cut behind words that their hash picks."""
    out: list[str] = []
    for line in text.split("\n"):
        if not line:
            continue
        if len(line) <= long:
            out.append(line)
            continue
        for part in _SENTENCE.split(line):
            if len(part) <= long:
                out.append(part)
                continue
            words = part.split(" ")
            first = 0
            for k, word in enumerate(words):
                if crc32(word.encode("utf-8", "surrogatepass")) & 7 == 0 or k == len(words) - 1:
                    out.append(" ".join(words[first : k + 1]))
                    first = k + 1
    return out


def digests(text: str) -> np.ndarray:
    """64-bit digests of the paragraphs; a paragraph's second occurrence has another digest than its first, and so on."""
    seen: dict[str, int] = {}
    out = []
    for part in paragraphs(text):
        k = seen.get(part, 0)
        seen[part] = k + 1
        out.append(xxhash.xxh3_64_intdigest(part.encode("utf-8", "surrogatepass"), seed=k))
    return np.array(out, dtype=np.uint64)


class Sketches:
    """IBLTs of several texts side by side. A cell has a count, the sum of its digests and the sum of their checks."""

    def __init__(self, cells: np.ndarray):
        self.sub = cells // 3
        self.base = np.concatenate(([0], np.cumsum(3 * self.sub)))
        self.count = np.zeros(self.base[-1], dtype=np.int64)
        self.keys = np.zeros(self.base[-1], dtype=np.uint64)
        self.checks = np.zeros(self.base[-1], dtype=np.uint64)

    def cell(self, owner: np.ndarray, keys: np.ndarray, table: int) -> np.ndarray:
        h = mixed(keys + np.uint64((table + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(20)
        sub = self.sub[owner]
        return self.base[owner] + table * sub + (h % sub.astype(np.uint64)).astype(np.int64)

    def add(self, owner: np.ndarray, keys: np.ndarray, sign: np.ndarray | int) -> None:
        """Insert with sign 1, remove with sign -1; sums wrap modulo 2**64."""
        factor = np.broadcast_to(np.asarray(sign, dtype=np.int64), keys.shape)
        weight = factor.view(np.uint64) if factor.flags.c_contiguous else factor.astype(np.uint64)
        first, second = keys * weight, mixed(keys ^ _CHECK) * weight & _LOW
        for table in range(3):
            at = self.cell(owner, keys, table)
            np.add.at(self.count, at, factor)
            np.add.at(self.keys, at, first)
            np.add.at(self.checks, at, second)
        self.checks &= _LOW

    def subtract(self, other: Sketches) -> None:
        """Cell by cell; both have the same numbers of cells."""
        self.count -= other.count
        self.keys -= other.keys
        self.checks = self.checks - other.checks & _LOW

    def sizes(self) -> np.ndarray:
        """The number of digests in each sketch: the sum of the counts of its first sub-table."""
        ends = np.concatenate(([0], np.cumsum(self.count)))
        return ends[self.base[:-1] + self.sub] - ends[self.base[:-1]]

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(owner, digest, sign) of all recovered entries, and for each sketch whether nothing is left."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        index = np.arange(len(self.count))
        owners = np.searchsorted(self.base, index, side="right") - 1
        tables = (index - self.base[owners]) // np.maximum(1, self.sub[owners])
        progress = True
        while progress:
            progress = False
            for table in range(3):
                at = np.flatnonzero((np.abs(self.count) == 1) & (tables == table))
                if not len(at):
                    continue
                sign = self.count[at]
                weight = sign.astype(np.uint64)
                keys = self.keys[at] * weight
                owner = owners[at]
                pure = (mixed(keys ^ _CHECK) & _LOW == self.checks[at] * weight & _LOW) & (self.cell(owner, keys, table) == at)
                if pure.any():
                    progress = True
                    found.append((owner[pure], keys[pure], sign[pure]))
                    self.add(owner[pure], keys[pure], -sign[pure])
        left = np.add.reduceat(((self.count != 0) | (self.keys != 0) | (self.checks != 0)).astype(np.int64), self.base[:-1]) if len(self.count) else np.zeros(0, np.int64)
        parts = zip(*found, strict=True) if found else ([np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)])
        return (*(np.concatenate(list(x)) for x in parts), left == 0)


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = [len(x) for x in sets]
    return np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets) if sum(sizes) else np.zeros(0, np.uint64)


def _by_pair(peeled: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """What was peeled, for each sketch: digests with sign 1 and with sign -1, or None where something is left."""
    owner, keys, sign, done = peeled
    order = np.argsort(owner, kind="stable")
    owner, keys, sign = owner[order], keys[order], sign[order]
    ends = np.searchsorted(owner, np.arange(len(done) + 1))
    out: list = []
    for k, whole in enumerate(done):
        mine = slice(ends[k], ends[k + 1])
        out.append((keys[mine][sign[mine] > 0], keys[mine][sign[mine] < 0]) if whole else None)
    return out


def stored(sets: list[np.ndarray], cells: int = CELLS) -> list[str]:
    """The sketches as base64 text: counts in 32 bits, digest sums in 64, check sums in 32."""
    sketches = Sketches(np.full(len(sets), cells, dtype=np.int64))
    owner, keys = _flat(sets)
    sketches.add(owner, keys, 1)
    out = []
    for first, last in zip(sketches.base[:-1], sketches.base[1:], strict=True):
        raw = sketches.count[first:last].astype("<i4").tobytes() + sketches.keys[first:last].astype("<u8").tobytes() + sketches.checks[first:last].astype("<u4").tobytes()
        out.append(base64.b64encode(raw).decode())
    return out


def loaded(fingerprints: list[str]) -> Sketches:
    """The sketches that stored() has written."""
    raws = [base64.b64decode(x) for x in fingerprints]
    sketches = Sketches(np.array([len(x) // 16 for x in raws], dtype=np.int64))
    for raw, first, last in zip(raws, sketches.base[:-1], sketches.base[1:], strict=True):
        n = last - first
        sketches.count[first:last] = np.frombuffer(raw, "<i4", n)
        sketches.keys[first:last] = np.frombuffer(raw, "<u8", n, 4 * n)
        sketches.checks[first:last] = np.frombuffer(raw, "<u4", n, 12 * n)
    return sketches


def compared(left: list[str], right: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray] | None], np.ndarray]:
    """From stored fingerprints alone: the digests that only the left and only the right has, or None where they differ in too many, and the digests of both."""
    ours, theirs = loaded(left), loaded(right)
    if (ours.sub != theirs.sub).any():
        raise ValueError("fingerprints of different sizes")
    total = ours.sizes() + theirs.sizes()
    ours.subtract(theirs)
    return _by_pair(ours.peel()), total


def differing(left: list[np.ndarray], right: list[np.ndarray], cells: int | np.ndarray = CELLS, tries: int = 8) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each pair the digests that only the left and only the right version has, and the cells it took.

    The sketches are subtracted and peeled; where something is left, both are built again with twice
    as many cells as there are digests, and then twice that. What no try resolves is compared digest by digest.
    """
    size = np.array(np.broadcast_to(cells, len(left)), dtype=np.int64)
    out: list = [None] * len(left)
    todo = np.arange(len(left))
    for _ in range(tries):
        if not len(todo):
            break
        sketches = Sketches(size[todo])
        for sets, sign in ((left, 1), (right, -1)):
            owner, keys = _flat([sets[k] for k in todo])
            sketches.add(owner, keys, sign)
        for k, part in zip(todo, _by_pair(sketches.peel()), strict=True):
            out[k] = part
        todo = todo[[out[k] is None for k in todo]]
        size[todo] = np.maximum(2 * size[todo], _twice([left[k] for k in todo], [right[k] for k in todo]))
    for k in todo:
        out[k] = (np.setdiff1d(left[k], right[k]), np.setdiff1d(right[k], left[k]))
    return out, size


def _twice(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Cells for twice the digests of each pair, in three sub-tables."""
    return np.array([3 * ((2 * (len(a) + len(b)) + 2) // 3) for a, b in zip(left, right, strict=True)], dtype=np.int64)


def likeness(left: list[np.ndarray], right: list[np.ndarray], left_stored: list[str], right_stored: list[str]) -> np.ndarray:
    """1 - differing / all digests of each pair; 1 where neither has any.

    The stored fingerprints are subtracted and peeled; those that differ in too many digests are built again larger.
    """
    parts, total = compared(left_stored, right_stored)
    again = [k for k, part in enumerate(parts) if part is None]
    a, b = [left[k] for k in again], [right[k] for k in again]
    for k, part in zip(again, differing(a, b, np.maximum(6, _twice(a, b)))[0], strict=True):
        parts[k] = part
    wrong = np.array([len(x[0]) + len(x[1]) for x in parts], dtype=float)
    return np.where(total > 0, 1 - wrong / np.maximum(total, 1), 1.0)


@F.pandas_udf(DoubleType())
def fingerprint_likeness(left: pd.Series, right: pd.Series) -> pd.Series:
    """Likeness of two columns of stored fingerprints of one size, null where one is null or they differ in more digests than peel (about 18 of 24 cells)."""
    out = pd.Series(np.nan, index=left.index)
    known = left.notna() & right.notna()
    if known.any():
        parts, total = compared(list(left[known]), list(right[known]))
        near = [np.nan if x is None else 1.0 if not n else 1 - (len(x[0]) + len(x[1])) / n for x, n in zip(parts, total, strict=True)]
        out[known] = near
    return out


def edited_text(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many (or all) of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k] if k else text


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(x.to_pylist() for x in batch.columns), strict=True)


def _fingerprinted(batches: Iterator[pa.RecordBatch], cells: int, names: list[str], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    def out(ids: list, texts: list[str], nexts: list[str]) -> pa.RecordBatch:
        edits = [edited_text(a, b) for a, b in zip(texts, nexts, strict=True)]
        own = [digests(x) for x in texts]
        changed = [digests(x) for x in edits]
        chained = all(a is b for a, b in zip(nexts[:-1], texts[1:], strict=True))
        after = own[1:] + [digests(nexts[-1])] if chained else [digests(x) for x in nexts]
        prints, changed_prints = stored(own, cells), stored(changed, cells)
        after_prints = prints[1:] + stored(after[-1:], cells) if chained else stored(after, cells)
        near = likeness(own + own, changed + after, prints + prints, changed_prints + after_prints)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, type=id_type),
                pa.array([len(x) for x in texts], type=pa.int64()),
                pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in edits]),
                pa.array(prints),
                pa.array(changed_prints),
                pa.array(near[: len(own)]),
                pa.array(near[len(own) :]),
            ],
            names=names,
        )

    held: tuple | None = None
    ids: list = []
    texts: list[str] = []
    nexts: list[str] = []
    size = 0
    for bucket, is_head, doc, text in _rows(batches):
        text = text or ""
        if held is not None and held[0] == bucket:
            ids.append(held[1])
            texts.append(held[2])
            nexts.append(text)
            size += len(held[2])
        held = None if is_head else (bucket, doc, text)
        if size > 1 << 19 or len(ids) >= 400:
            yield out(ids, texts, nexts)
            ids, texts, nexts, size = [], [], [], 0
    if ids:
        yield out(ids, texts, nexts)


def with_following(df: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """Rows (_bucket, _head, id, text), dealt and sorted so that each text is followed by the next in descending id order.

    Ids are cut into ranges at approximate quantiles. The first text of each range, one row a range,
    is also sent to the end of the range before it (of the last range, for the first).
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    rows = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"), key.alias("_key"))
    cuts = rows.agg(F.percentile_approx("_key", [k / buckets for k in range(1, buckets)], 10 * buckets)).first()[0] or []
    limits = F.array(*(F.lit(int(x)).cast("long") for x in sorted(set(cuts)))) if cuts else F.array().cast("array<bigint>")

    def bucket(of: Column) -> Column:
        return F.size(F.filter(limits, lambda cut: cut > of))

    heads = sorted((r[0], r[1]) for r in rows.groupBy(bucket(F.col("_key")).alias("b")).agg(F.max("_key")).collect())  # a row for each range
    rows = rows.withColumn("_bucket", bucket(F.col("_key"))).withColumn("_head", F.lit(False))
    if not heads:
        return rows.select("_bucket", "_head", "_id", "_text")
    before = {first: heads[k - 1][0] for k, (_, first) in enumerate(heads)}
    spark = df.sparkSession
    where = spark.createDataFrame([(int(k), int(b)) for k, b in before.items()], "_key long, _to int")
    copies = rows.join(F.broadcast(where), "_key").select("_id", "_text", "_key", F.col("_to").alias("_bucket"), F.lit(True).alias("_head"))
    rows = rows.unionByName(copies)
    return rows.repartition(buckets, "_bucket").sortWithinPartitions("_bucket", "_head", F.desc("_key"), "_text").select("_bucket", "_head", "_id", "_text")


def fingerprint_versions(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", cells: int = CELLS, buckets: int | None = None) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row.

    The edited text ends with the beginning of the next text in descending id order; ties of an id
    follow each other in text order, null ids come last, and the last row is followed by the first.
    A single row is followed by itself. Null text counts as empty; two empty texts have likeness 1.
    Other columns are not read. An empty table gives an empty result. Rows of one id stay in one range.
    """
    spark = df.sparkSession
    small_batches(spark)
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kind = df.schema[id_col].dataType.simpleString()
    arrow = {"int": pa.int32(), "bigint": pa.int64()}[kind]
    schema = f"`{id_col}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_following(df, id_col, text_col, buckets).mapInArrow(lambda it: _fingerprinted(it, cells, names, arrow), schema)
