"""Spelling variants: words at one edit from each other, found by range searches in k-d trees over letter-count vectors.

One inserted, deleted or replaced letter changes the counts of letters by one or by one up and one down. So for words
a of length l and b, b' of length l + 1: if a and b are near, a = b - e_x as count vectors, and if b and b' are near,
b - e_x = b' - e_y. There is a tree for each l. It holds the words of length l at their own vectors and is searched
with the words of length l + 1 for the range of all vectors with one letter less: each split of the tree is a side of
a box, and a search goes on only into boxes that the range meets. Words that are near meet in a box this way. A pair
that differs by a replaced letter may meet in several boxes; the one that holds the vector of the letters they share
counts. What meets is compared by counts first and then letter by letter, so the result is exact.

The upper part of the trees deals the words to tasks. It is fitted on a bounded sample, which decides nothing but
the sizes of the parts: each word goes to every part its range meets. In a task a tree of its own goes further down.

Texts are read whole and counted in each task before the shuffle. Defined cases: null and empty texts have no words;
a null id counts as the empty text in the hash; repeated rows count again. Empty input gives no rows. Ties between
near words go to the smallest word in code-point order. Long runs are words like others. Columns besides id and text
are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgraph.plans.scratch import written

#: Letters of words: a-z and U+00C0 to U+00FF; all of them are single bytes in Latin-1.
_DIM = np.full(256, 0, dtype=np.int64)
_DIM[ord("a") : ord("z") + 1] = np.arange(26)
_DIM[0xC0:0x100] = 26 + np.arange(64)
DIMS = 90
#: One in so many occurrences loses a letter, by hash of document and word.
VARIED = 31
#: Words of a part of a tree that one task searches, before copies.
PART = 8192
#: Parts of all trees together at most; parts grow beyond it.
MOST_PARTS = 4096
#: Words that the upper trees are fitted on.
SAMPLE = 100_000
#: Words of a box that are compared with each other.
BOX = 256
#: Distinct words that a task counts before it hands them on.
COUNTED = 200_000


def varied(word: str, start: int) -> str:
    """The word, or the word without one letter, by the crc32 of what `start` has begun and the word."""
    h = zlib.crc32(word.encode("utf-8"), start)
    if h % VARIED:
        return word
    cut = h % len(word)
    return word[:cut] + word[cut + 1 :]


def count_words(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = 7, least: int = 2) -> DataFrame:
    """(word, n): words of at least `shortest` letters that occur at least `least` times, after the variation above."""
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % shortest)  # a shorter run can't become a word

    def batch_of(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for key, line in zip(batch.column(0).to_pylist(), pc.ascii_lower(batch.column(1))):
                start = zlib.crc32(f"{key}:".encode())
                for word, n in Counter(runs.findall(line.as_py() or "")).items():
                    word = varied(word, start)
                    if len(word) >= shortest:
                        counts[word] += n
                if len(counts) > COUNTED:
                    yield batch_of(counts)
                    counts = Counter()
        yield batch_of(counts)

    rows = documents.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("k"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def letter_counts(words: list[str]) -> np.ndarray:
    """A row of letter counts for each word; counts over 255 stay at 255, which never takes vectors further apart."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    letters = _DIM[np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8)]
    out = np.empty((len(words), DIMS), dtype=np.uint8)
    at = np.concatenate([[0], np.cumsum(lengths)])
    for k in range(0, len(words), 4096):
        m = min(4096, len(words) - k)
        rows = np.repeat(np.arange(m), lengths[k : k + m])
        counts = np.bincount(rows * DIMS + letters[at[k] : at[k + m]], minlength=m * DIMS)
        out[k : k + m] = np.minimum(counts, 255).reshape(m, DIMS)
    return out


class Tree:
    """A k-d tree over count vectors: an inner node sends vectors with counts[dim] <= limit to the left."""

    def __init__(self, points: np.ndarray, leaves: int, smallest: int = 1):
        self.dim, self.limit, self.left, self.right, self.leaf = [], [], [], [], []
        self.leaves = 0
        self._grow(points, leaves, smallest)

    def _grow(self, points: np.ndarray, leaves: int, smallest: int) -> int:
        at = len(self.dim)
        for x, v in ((self.dim, -1), (self.limit, 0), (self.left, -1), (self.right, -1), (self.leaf, -1)):
            x.append(v)
        split = self._split(points) if leaves > 1 and len(points) > smallest else None
        if split is None:
            self.leaf[at] = self.leaves
            self.leaves += 1
            return at
        self.dim[at], self.limit[at] = split
        low = points[:, split[0]] <= split[1]
        share = min(leaves - 1, max(1, round(leaves * float(low.mean()))))
        self.left[at] = self._grow(points[low], share, smallest)
        self.right[at] = self._grow(points[~low], leaves - share, smallest)
        return at

    @staticmethod
    def _split(points: np.ndarray) -> tuple[int, int] | None:
        """(dim, limit) that come nearest to halves; None if all points are equal."""
        best, found = 0, None
        for limit in range(min(int(points.max()), 8)):
            low = (points <= limit).sum(axis=0)
            small = np.minimum(low, len(points) - low)
            k = int(small.argmax())
            if small[k] > best:
                best, found = int(small[k]), (k, limit)
        if found is None:
            spread = points.max(axis=0) - points.min(axis=0)
            k = int(spread.argmax())
            found = (k, int(np.sort(points[:, k])[(len(points) - 1) // 2])) if spread[k] else None
            if found and found[1] == points[:, k].max():
                found = (k, found[1] - 1)
        return found

    def places(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        out = np.zeros(len(points), dtype=np.int64)
        stack = [(0, np.arange(len(points)))]
        while stack:
            at, rows = stack.pop()
            if self.leaf[at] >= 0:
                out[rows] = self.leaf[at]
            elif len(rows):
                low = points[rows, self.dim[at]] <= self.limit[at]
                stack += [(self.left[at], rows[low]), (self.right[at], rows[~low])]
        return out

    def below(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, leaves): all leaves that hold a vector with one letter less than the row's; some others may be among them."""
        rows_out, leaves_out = [], []
        stack = [(0, np.arange(len(points)), np.full(len(points), -1))]
        while stack:
            at, rows, used = stack.pop()
            if not len(rows):
                continue
            if self.leaf[at] >= 0:
                rows_out.append(rows)
                leaves_out.append(np.full(len(rows), self.leaf[at], dtype=np.int64))
                continue
            value = points[rows, self.dim[at]].astype(np.int64) - (used == self.dim[at])
            low = value <= self.limit[at]
            cross = (used < 0) & (value == self.limit[at] + 1)
            stack.append((self.left[at], np.concatenate([rows[low], rows[cross]]), np.concatenate([used[low], np.full(int(cross.sum()), self.dim[at])])))
            stack.append((self.right[at], rows[~low], used[~low]))
        return (np.concatenate(rows_out), np.concatenate(leaves_out)) if rows_out else (np.zeros(0, dtype=np.int64),) * 2


def _bits(counts: np.ndarray, cap: int = 3) -> np.ndarray:
    """Counts up to cap as rows of ones, so that products are sums of minima; columns without letters are left out."""
    parts = [counts[:, (counts >= k).any(axis=0)] >= k for k in range(1, cap + 1)]
    return np.concatenate(parts, axis=1).astype(np.float32)


def near_pairs(words: list[str], shorter: int, keep=None) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of words of lengths `shorter` and one more that are one edit apart: those of different length, and those of the greater length.

    keep(vectors) tells for each vector of shared letters whether a pair of the greater length counts here.
    """
    lengths = np.array([len(w) for w in words])
    small, large = np.flatnonzero(lengths == shorter), np.flatnonzero(lengths == shorter + 1)
    nothing = (np.zeros(0, dtype=np.int64),) * 2
    if not len(large):
        return nothing
    counts = letter_counts(words)
    letters = {n: np.frombuffer("".join(words[k] for k in rows).encode("latin-1"), dtype=np.uint8).reshape(len(rows), n) for n, rows in ((shorter, small), (shorter + 1, large))}
    place = np.zeros(len(words), dtype=np.int64)
    place[small], place[large] = np.arange(len(small)), np.arange(len(large))
    tree = Tree(counts, max(1, len(words) // BOX), BOX)
    home = tree.places(counts[small])
    met, leaves = tree.below(counts[large])
    by_home, by_leaf = np.argsort(home, kind="stable"), np.argsort(leaves, kind="stable")
    home_at, leaf_at = np.searchsorted(home[by_home], np.arange(tree.leaves + 1)), np.searchsorted(leaves[by_leaf], np.arange(tree.leaves + 1))
    found_i, found_j = [], []
    bits = _bits(counts)
    size = bits.sum(axis=1)

    for leaf in range(tree.leaves):
        b = large[met[by_leaf[leaf_at[leaf] : leaf_at[leaf + 1]]]]
        a = small[by_home[home_at[leaf] : home_at[leaf + 1]]]
        for k in range(0, len(b), 1024):
            part = b[k : k + 1024]
            for m in range(0, len(a), 1024):
                other = a[m : m + 1024]
                x, y = np.nonzero(size[part][:, None] + size[other][None, :] - 2 * (bits[part] @ bits[other].T) <= 1)
                if len(x):
                    big, less = letters[shorter + 1][place[part[x]]], letters[shorter][place[other[y]]]
                    front = big[:, :-1] != less
                    first = np.where(front.any(axis=1), front.argmax(axis=1), shorter)
                    behind = big[:, 1:] != less
                    last = np.where(behind.any(axis=1), shorter - 1 - behind[:, ::-1].argmax(axis=1), -1)
                    good = last < first
                    found_i.append(part[x[good]])
                    found_j.append(other[y[good]])
            for m in range(k, len(b), 1024):
                other = b[m : m + 1024]
                x, y = np.nonzero(size[part][:, None] + size[other][None, :] - 2 * (bits[part] @ bits[other].T) <= 2)
                if m == k:
                    x, y = x[x < y], y[x < y]
                if len(x):
                    p, q = letters[shorter + 1][place[part[x]]], letters[shorter + 1][place[other[y]]]
                    good = (p != q).sum(axis=1) == 1
                    i, j = part[x[good]], other[y[good]]
                    shared = np.minimum(counts[i], counts[j])
                    here = tree.places(shared) == leaf
                    if keep is not None:
                        here &= keep(shared)
                    found_i.append(i[here])
                    found_j.append(j[here])
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else nothing


def _upper_trees(words: DataFrame, part: int, most_parts: int, sample: int) -> dict[int, Tree]:
    """A tree for each length l for which the words of lengths l and l + 1 don't fit in one part; fitted on at most about `sample` words."""
    sizes = {r["l"]: r["m"] for r in words.groupBy(F.length("word").alias("l")).agg(F.count("*").alias("m")).where(F.col("m") > part // 2).collect()}
    wanted = {n: (sizes.get(n, 0) + sizes.get(n + 1, 0)) / part for n in {*sizes, *(k - 1 for k in sizes)}}
    wanted = {n: x for n, x in wanted.items() if x > 1}
    if not wanted:
        return {}
    shrink = min(1.0, most_parts / sum(wanted.values()))
    lengths = sorted({*wanted, *(n + 1 for n in wanted)})
    share = min(1.0, sample / sum(sizes.get(n, 0) for n in lengths))
    rows = words.where(F.length("word").isin(lengths) & (F.pmod(F.xxhash64("word"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)).select("word").limit(2 * sample).collect()
    by_length: dict[int, list[str]] = {}
    for r in sorted(r["word"] for r in rows):
        by_length.setdefault(len(r), []).append(r)
    return {n: Tree(letter_counts([*by_length.get(n, []), *by_length.get(n + 1, [])]), max(1, math.ceil(x * shrink))) for n, x in wanted.items() if n in by_length or n + 1 in by_length}


def near_words(words: DataFrame, part: int = PART, most_parts: int = MOST_PARTS, sample: int = SAMPLE) -> DataFrame:
    """(word, n_near, best_n, best) in partial rows: how many words of (word, n) are one edit away, and the one of largest n, by part."""
    trees = words.sparkSession.sparkContext.broadcast(_upper_trees(words, part, most_parts, sample))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = np.array(batch.column(0).to_pylist(), dtype=object)
            n = batch.column(1).to_numpy()
            lengths = np.array([len(w) for w in texts], dtype=np.int64)
            for length in np.unique(lengths):
                rows = np.flatnonzero(lengths == length)
                counts = letter_counts(texts[rows].tolist())
                for level in (length, length - 1):
                    tree = trees.value.get(int(level))
                    if tree is None:
                        own, leaves = np.arange(len(rows)), np.zeros(len(rows), dtype=np.int64)
                    elif level == length:
                        own, leaves = np.arange(len(rows)), tree.places(counts)
                    else:
                        own, leaves = tree.below(counts)
                    for k in range(0, len(own), 50_000):
                        some = rows[own[k : k + 50_000]]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), level), pa.int64()), pa.array(leaves[k : k + 50_000], pa.int64()), pa.array(texts[some].tolist(), pa.string()), pa.array(n[some], pa.int64())], names=["level", "leaf", "word", "n"])

    def search(key: tuple, rows: pa.Table) -> pa.Table:
        level, leaf = key[0].as_py(), key[1].as_py()
        texts, n = rows.column("word").to_pylist(), rows.column("n").to_numpy()
        tree = trees.value.get(level)
        i, j = near_pairs(texts, level, None if tree is None else lambda shared: tree.places(shared) == leaf)
        one, other = np.concatenate([i, j]), np.concatenate([j, i])
        rank = np.empty(len(texts), dtype=np.int64)
        rank[sorted(range(len(texts)), key=texts.__getitem__)] = np.arange(len(texts))
        order = np.lexsort((rank[other], -n[other], one))
        one, other = one[order], other[order]
        word, first, near = np.unique(one, return_index=True, return_counts=True)
        best = other[first]
        return pa.table({"word": pa.array([texts[k] for k in word], pa.string()), "n_near": pa.array(near, pa.int64()), "best_n": pa.array(n[best], pa.int64()), "best": pa.array([texts[k] for k in best], pa.string())})

    dealt = words.mapInArrow(deal, "level long, leaf long, word string, n long")
    return dealt.groupBy("level", "leaf").applyInArrow(search, "word string, n_near long, best_n long, best string")


def group_variants(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = 7, least: int = 2, ratio: int = 10, part: int = PART) -> DataFrame:
    """(word, form, root, n, n_near, form_n): form is the near word of largest n if that is at least ratio * n, for a ratio of 2 or more; root is where forms lead."""
    words = written(count_words(documents, doc_id, text, shortest, least), "words")
    near = near_words(words, part)
    rows = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"))
    rows = rows.unionByName(near.withColumn("n", F.lit(None).cast("long")))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("k"), F.col("best").alias("w"))))
    merged = rows.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b"))
    fits = -F.col("b.k") >= ratio * F.col("n")
    formed = written(merged.select("word", F.when(fits, F.col("b.w")).alias("form"), "n", "n_near", F.when(fits, -F.col("b.k")).alias("form_n")), "forms")
    # each step multiplies n by the ratio, so the largest n bounds the length of a chain
    most = formed.agg(F.max("form_n")).first()[0]
    roots = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    if most:
        steps = 1
        while least * ratio ** (steps + 1) <= most:  # a chain of more than `steps` forms may be left
            onward = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
            roots = written(roots.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "roots")
            steps *= 2
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
