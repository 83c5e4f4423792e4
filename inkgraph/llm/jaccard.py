"""N-gram Jaccard join: exact links between texts whose sets of word shingles are alike.

The join never lists the pairs of a group. Four steps keep it exact and in proportion to the input:

1. Texts with equal sets are one set from here on.
2. Two sets of a link share all but a few shingles. So a set whose first shingles, rarest first, are in
   no other set has no link, and two linked sets share one of those prefixes' shingles. Counts of the
   shingles in the lowest part of the hash range are enough to order the prefixes.
3. Sets that share prefix shingles directly or through others form a pool. A pool is cut into bands of
   size, so that links stay inside a band or between neighbours, and large bands into blocks. A tile is
   a pair of blocks.
4. In a tile every set has a hashed bitmap; the bits in which two differ bound their overlap from above.
   Only pairs that the bound lets through have their sorted arrays intersected. A tile gives as few links
   as connect what it links, and for each set the number of its links there. Every pair is in one tile at
   most, so these numbers add up. Where they are not asked for, connected pairs are passed over.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgraph.llm import bytes as by
from inkgraph.llm.common import small_batches
from inkgraph.operators.components import connected_components
from inkgraph.plans.scratch import written

_TOP = np.uint64(1 << 63)
_EMPTY = 0
#: Shingles that the blocks of a tile hold at most, about; and their sets.
BLOCK_SHINGLES, BLOCK_SETS = 4_000_000, 1024


def shared_least(n, percent: int):
    """The least overlap of a set of n with any set it links to."""
    return -(-percent * n // 100)


def text_sets(column: pa.Array, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(identity, shingles one after the other, offsets) for runs of rows. Identity: 64 bits of the whole set, 0 for none."""
    data, offsets = by.flat(column)
    for first, last in by.steps(offsets):
        part = offsets[first : last + 1]
        words = by.Words(data[part[0] : part[-1]], part - part[0])
        hashes, owner, _ = by.shingles(words, size)
        values, ends = by.distinct_per_text(hashes, owner, last - first)
        running = np.concatenate((np.zeros(1, np.uint64), np.cumsum(by.mixed(values ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)))
        n = np.diff(ends)
        identity = by.mixed(running[ends[1:]] - running[ends[:-1]] + n.astype(np.uint64))
        identity[identity == 0] = 1
        yield np.where(n > 0, identity, np.uint64(_EMPTY)).view(np.int64), values, ends


def _identified(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = list(text_sets(batch.column(1), size))
        sids = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
        n = np.concatenate([np.diff(p[2]) for p in parts]) if parts else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sids), pa.array(n)], names=[batch.schema.names[0], "text_hash", "sid", "n_shingles"])


def identities(documents: DataFrame, size: int) -> DataFrame:
    """(doc_id, text_hash, sid, n_shingles): equal sets have equal sids, 0 stands for the empty set."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", F.col("text").cast("string").alias("_text"), F.xxhash64(F.col("text").cast("string")).alias("text_hash")).mapInArrow(lambda it: _identified(it, size), f"doc_id {kind}, text_hash long, sid long, n_shingles long")


def _low_shingles(batches: Iterator[pa.RecordBatch], size: int, percent: int, part: float) -> Iterator[pa.RecordBatch]:
    """(key, sid, n) of the shingles in the low part of the hash range, or of the prefix where that is more; each set once a task."""
    limit = np.uint64(min(int(part * 2.0**64), (1 << 64) - 1))
    seen: set[int] = set()
    for batch in batches:
        for sids, values, ends in text_sets(batch.column(0), size):
            keys, owners = [], []
            for k, sid in enumerate(sids.tolist()):
                if sid == _EMPTY or sid in seen:
                    continue
                seen.add(sid)
                own = values[ends[k] : ends[k + 1]]
                take = max(int(np.searchsorted(own, limit)), len(own) - shared_least(len(own), percent) + 1)
                keys.append(own[:take])
                owners.append((k, min(take, len(own))))
            if keys:
                rows = np.repeat([k for k, _ in owners], [m for _, m in owners])
                yield pa.RecordBatch.from_arrays([pa.array((np.concatenate(keys) ^ _TOP).view(np.int64)), pa.array(sids[rows]), pa.array(np.diff(ends)[rows])], names=["key", "sid", "n"])


def _runs(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[list[np.ndarray]]:
    """The columns of sorted batches in pieces that end where the value of one column does."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
        if held is not None:
            new = [np.concatenate(x) for x in zip(held, new, strict=True)]
        cut = int(np.searchsorted(new[column], new[column][-1]))
        if cut:
            yield [x[:cut] for x in new]
        held = [x[cut:].copy() for x in new]
    if held is not None:
        yield held


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key and sid: (sid, df, key, n) of shingles in two sets or more; with df 0 and a number as key, how many others a set has."""
    for key, sid, n in _runs(batches, 0):
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])
        key, sid, n = key[new], sid[new], n[new]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        df = np.repeat(np.diff(np.append(first, len(key))), np.diff(np.append(first, len(key))))
        alone, where = df == 1, df > 1
        own, at, count = np.unique(sid[alone], return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((own, sid[where]))), pa.array(np.concatenate((np.zeros(len(own), np.int64), df[where]))), pa.array(np.concatenate((count, key[where]))), pa.array(np.concatenate((n[alone][at], n[where])))], names=["sid", "df", "key", "n"])


def _prefixed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """From rows sorted by sid, df and key: (key, sid, n) of the shared shingles that fall into the set's prefix."""
    for sid, df, key, n in _runs(batches, 0):
        first = np.flatnonzero(np.concatenate(([True], sid[1:] != sid[:-1])))
        lengths = np.diff(np.append(first, len(sid)))
        shared = df > 0
        alone = np.add.reduceat(np.where(shared, 0, key), first)
        lone_rows = np.add.reduceat((~shared).astype(np.int64), first)
        place = np.arange(len(sid)) - np.repeat(first + lone_rows, lengths)
        room = n - shared_least(n, percent) + 1 - np.repeat(alone, lengths)
        keep = shared & (place < room)
        yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(sid[keep]), pa.array(n[keep])], names=["key", "sid", "n"])


def candidates(documents: DataFrame, size: int, percent: int) -> DataFrame:
    """(key, sid, n): prefix shingles that several sets may share. Linked sets share a key."""
    part = min(1.0, 1.7 * (1 - percent / 100) + 0.01)
    low = documents.select(F.col("text").cast("string").alias("_text")).mapInArrow(lambda it: _low_shingles(it, size, percent, part), "key long, sid long, n long")
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = low.repartition(parts, "key").sortWithinPartitions("key", "sid").mapInArrow(_counted, "sid long, df long, key long, n long")
    return counted.repartition(parts, "sid").sortWithinPartitions("sid", "df", "key").mapInArrow(lambda it: _prefixed(it, percent), "key long, sid long, n long")


def pools(shared: DataFrame) -> DataFrame:
    """(sid, n, pool) of sets that share prefix keys: connected by a star for each key."""
    least = shared.groupBy("key").agg(F.min("sid").alias("least"), F.count("*").alias("c")).where("c > 1")
    stars = shared.join(least, "key").where("sid <> least").select("sid", "least").distinct()
    found = connected_components(stars, "sid", "least")
    return found.withColumnRenamed("node", "sid").withColumnRenamed("component", "pool").join(shared.groupBy("sid").agg(F.max("n").alias("n")), "sid")


def tiles(members: DataFrame, percent: int) -> DataFrame:
    """(pool, band, kind, i, j, side, sid): where each set is to be compared.

    kind 0: blocks i and j of a band; kind 1: block i of a band with block j of the next. A set of a
    band with few sets is in one tile, and in one more for each neighbouring band there is.
    """
    step = math.log(100 / percent) * 1.0001  # a little wider than a link's largest ratio
    banded = members.withColumn("band", F.floor(F.ln("n") / step).cast("int"))
    blocks = banded.groupBy("pool", "band").agg(F.count("*").alias("m"), F.max("n").alias("top"))
    room = F.greatest(F.lit(1), F.least(F.lit(BLOCK_SETS), F.floor(F.lit(float(BLOCK_SHINGLES)) / F.col("top")).cast("int")))
    blocks = blocks.select("pool", "band", F.ceil(F.col("m") / room).cast("int").alias("blocks"), "m")
    here = blocks.select("pool", "band", F.col("blocks").alias("nb"), "m")
    above = blocks.select("pool", (F.col("band") - 1).alias("band"), F.col("blocks").alias("na"))
    below = blocks.select("pool", (F.col("band") + 1).alias("band"), F.col("blocks").alias("nd"))
    sized = here.join(above, ["pool", "band"], "left").join(below, ["pool", "band"], "left").na.fill(0, ["na", "nd"])
    placed = banded.join(sized, ["pool", "band"]).withColumn("b", F.pmod(F.xxhash64("sid"), F.col("nb")).cast("int"))

    def numbers(n):
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def tile(band, kind, i, j, side):
        return F.struct(band.cast("int").alias("band"), F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"))

    b = F.col("b")
    own = F.transform(F.when(F.col("m") > 1, numbers(F.col("nb"))).otherwise(F.array().cast("array<int>")), lambda x: tile(F.col("band"), 0, F.least(b, x), F.greatest(b, x), F.when(x < b, 1).otherwise(0)))
    up = F.transform(numbers(F.col("na")), lambda x: tile(F.col("band"), 1, b, x, F.lit(0)))
    down = F.transform(numbers(F.col("nd")), lambda x: tile(F.col("band") - 1, 1, x, b, F.lit(1)))
    return placed.select("sid", "pool", F.explode(F.concat(own, up, down)).alias("t")).select("pool", "t.*", "sid")


def bitmaps(values: list[np.ndarray], bits: int) -> np.ndarray:
    """A row of bits for each set: a bit says whether an odd number of its shingles falls there."""
    owner = np.repeat(np.arange(len(values)), [len(v) for v in values])
    at = (np.concatenate(values) >> np.uint64(17)) % np.uint64(bits)
    flat = np.bincount(owner * bits + at.astype(np.int64), minlength=len(values) * bits) & 1
    return np.packbits(flat.astype(np.uint8).reshape(len(values), bits), axis=1).view(np.uint64)


class _Overlaps:
    """Sizes of the intersections of a tile's sets, which are sorted arrays."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.ends = np.concatenate(([0], np.cumsum([len(v) for v in sets])))
        self.ranks: np.ndarray | None = None
        self.held = np.zeros(0, dtype=bool)

    def of(self, a: int, others: np.ndarray) -> np.ndarray:
        """Of set a with each of the others; for many of them by ranks among the tile's shingles."""
        if len(others) < 8:
            return np.array([self._pair(self.sets[a], self.sets[b]) for b in others.tolist()], dtype=np.int64)
        if self.ranks is None:
            distinct, ranks = np.unique(np.concatenate(self.sets), return_inverse=True)
            self.ranks, self.held = ranks.astype(np.int32), np.zeros(len(distinct), dtype=bool)
        own = self.ranks[self.ends[a] : self.ends[a + 1]]
        self.held[own] = True
        first, last = int(others[0]), int(others[-1]) + 1
        start = self.ends[first]
        both = np.add.reduceat(self.held[self.ranks[start : self.ends[last]]], self.ends[first:last] - start, dtype=np.int64)
        self.held[own] = False
        return both[others - first]

    @staticmethod
    def _pair(small: np.ndarray, large: np.ndarray) -> int:
        at = np.minimum(np.searchsorted(large, small), len(large) - 1)
        return int((large[at] == small).sum())


def links_in_tile(sids: np.ndarray, sets: list[np.ndarray], side: np.ndarray, cross: bool, percent: int, copies: np.ndarray | None = None) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """(links that connect all that the tile's links connect, sid -> texts that it links with). cross: only pairs with one set on either side.

    copies: texts of each set. Without it nothing is counted, and pairs that are connected already are not intersected.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    sids, sets, side = sids[order], [sets[k] for k in order], side[order]
    weight = None if copies is None else copies[order]
    n = np.array([len(s) for s in sets], dtype=np.int64)
    maps = bitmaps(sets, max(64, 1 << int(n[-1] - 1).bit_length()))
    overlaps = _Overlaps(sets)
    totals = np.zeros(len(sets), dtype=np.int64)
    parent = np.arange(len(sets))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return int(x)

    out = []

    def connect(a: int, b: int) -> None:
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((int(sids[a]), int(sids[b])))

    for a in range(len(sets) - 1):
        last = int(np.searchsorted(n, n[a] * 100 // percent, side="right"))
        if last <= a + 1:
            continue
        near = slice(a + 1, last)
        apart = np.bitwise_count(maps[near] ^ maps[a]).sum(axis=1, dtype=np.int64)
        both = n[a] + n[near]
        most = (both - apart) // 2
        fits = 100 * most >= percent * (both - most)
        if cross:
            fits &= side[near] != side[a]
        others = np.flatnonzero(fits) + a + 1
        if weight is None:
            for b in others.tolist():
                if root(a) != root(b):
                    overlap = overlaps._pair(sets[a], sets[b])
                    if 100 * overlap >= percent * (int(n[a] + n[b]) - overlap):
                        connect(a, b)
        elif len(others):
            overlap = overlaps.of(a, others)
            linked = others[100 * overlap >= percent * (n[a] + n[others] - overlap)]
            totals[a] += weight[linked].sum()
            totals[linked] += weight[a]
            for b in linked.tolist():
                connect(a, b)
    some = np.flatnonzero(totals)
    return out, dict(zip(sids[some].tolist(), totals[some].tolist(), strict=True))


def _linked(batches: Iterator[pa.RecordBatch], size: int, percent: int, count: bool) -> Iterator[pa.RecordBatch]:
    """Tiles arrive whole and one after the other: pool, band, kind, i, j, side, sid, copies, text. Rows with a null b hold a's number of links in a tile."""
    held: tuple | None = None
    sids: list[int] = []
    sets: list[np.ndarray] = []
    side: list[int] = []
    copies: list[int] = []
    out: list[tuple[int, int | None, int]] = []

    def close() -> None:
        if len(sets) > 1:
            links, totals = links_in_tile(np.array(sids), sets, np.array(side), held[2] == 1 or held[3] != held[4], percent, np.array(copies) if count else None)
            out.extend((a, b, 0) for a, b in links)
            out.extend((sid, None, n) for sid, n in totals.items())

    def rows() -> pa.RecordBatch:
        columns = [pa.array([row[k] for row in out], type=pa.int64()) for k in range(3)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, names=["a", "b", "n"])

    for batch in batches:
        found = [(sid, values[ends[k] : ends[k + 1]]) for own, values, ends in text_sets(batch.column(8), size) for k, sid in enumerate(own.tolist())]
        for pool, band, kind, i, j, s, want, c, (sid, own) in zip(*(batch.column(k).to_pylist() for k in range(8)), found, strict=True):
            if sid != want:  # another text with the same hash
                continue
            tile = (pool, band, kind, i, j)
            if tile != held:
                close()
                held, sids, sets, side, copies = tile, [], [], [], []
            if not sids or sids[-1] != sid:
                sids.append(sid)
                sets.append(own.copy())
                side.append(s)
                copies.append(c)
        if out:
            yield rows()
    if held is not None:
        close()
    if out:
        yield rows()


def set_links(documents: DataFrame, slim: DataFrame, size: int, percent: int, count: bool) -> DataFrame:
    """(a, b, n): links between different sets, enough of them to connect all that links connect; with count, rows without b add n to a's number of links."""
    spark = documents.sparkSession
    shared = written(candidates(documents, size, percent), "candidates")
    places = written(tiles(pools(shared), percent), "tiles")
    first = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    # one row of each set: ids alone may repeat, or be null, with other texts
    chosen = slim.join(places.select("sid").distinct(), "sid", "left_semi").groupBy("sid").agg(F.min(F.struct(first.alias("_doc"), "text_hash")).alias("_row"), F.count("*").alias("copies")).select("sid", "copies", "_row.*")
    texts = documents.select(first.alias("_doc"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("_text")).join(chosen, ["_doc", "text_hash"])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = places.join(texts, "sid").select("pool", "band", "kind", "i", "j", "side", "sid", "copies", "_text")
    rows = rows.repartition(parts, "pool", "band", "kind", "i", "j").sortWithinPartitions("pool", "band", "kind", "i", "j", "sid")
    return rows.mapInArrow(lambda it: _linked(it, size, percent, count), "a long, b long, n long")


def _classified(documents: DataFrame, size: int, percent: int, count: bool) -> DataFrame:
    """link_classes, whose n_links are counted only where count is set."""
    small_batches(documents.sparkSession)
    slim = written(identities(documents, size), "sets")
    found = written(set_links(documents, slim, size, percent, count), "links")
    classes = connected_components(found.where("b IS NOT NULL").select("a", "b"), "a", "b")
    sets = slim.where(F.col("sid") != _EMPTY).groupBy("sid").agg(F.min("doc_id").alias("least"), (F.count("*") - 1).alias("equal"))
    sets = sets.join(classes, sets.sid == classes.node, "left").select("sid", "least", "equal", F.coalesce("component", "sid").alias("class"))
    named = sets.join(sets.groupBy("class").agg(F.min("least").alias("component_id")), "class")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("sid")).agg(F.sum("n").alias("other"))
    named = named.join(counts, "sid", "left").select("sid", "component_id", (F.col("equal") + F.coalesce("other", F.lit(0))).alias("n_links"))
    component = F.when(F.col("sid") == _EMPTY, F.col("doc_id")).otherwise(F.col("component_id"))
    return slim.join(named, "sid", "left").select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def link_classes(documents: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of each row: texts link when 100 * overlap >= percent * union of their shingle sets.

    Words are runs of bytes other than white space, A-Z lower-cased; a text of fewer than `size` words
    has its whole sequence as one shingle. Shingles are compared by 64-bit hashes. component_id is the
    smallest doc_id that links reach, n_links the number of other rows that the row links with. A text without words (null, empty, blank) has an empty set and is
    its own class. Rows that repeat a doc_id are each a text of their own; null ids are never smallest,
    and a class of null ids has a null component_id. Other columns are not read. No rows: no result.
    """
    return _classified(documents, size, percent, count=True)


def one_of_each(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of documents, all columns, without those whose class has a smaller doc_id; texts without words stay.

    Rows of one doc_id share a fate: they stay if the id is the smallest of a class of any of them. Null ids stay.
    """
    classes = _classified(documents, size, percent, count=False)
    going = classes.groupBy("doc_id").agg(F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays")).where("NOT stays").select(F.col("doc_id").alias("_gone"))
    return documents.join(going, F.col("doc_id") == F.col("_gone"), "left_anti")
