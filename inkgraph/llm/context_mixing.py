"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is its words, A-Z lower-cased, and one end sign. Every token is coded by binary decisions, each
predicted from several hashed contexts:

1. A match bit, where the two tokens before it were met: "is it the word that followed them?" Inside the
   text that is the word that followed last; else the word that most of the other learnt texts have.
2. If there is no match, the bits of the token in a Huffman tree over the frequent words. Predictors: the
   node alone, the node after the word before (hashed to CLASSES classes), what the text itself has shown
   at the node.
3. Behind the tree's escape, the bytes of a rare word in a Huffman tree over bytes. Predictors: the node
   after the last byte, after the last three bytes, after the same beginning of a word in the text.

The predictors' log odds are summed with weights that a gate picks from how much the contexts have seen.
From block to block of a text the weights are refined by the gradient of the bits just coded. A bit's
probability never depends on later bits and its two values sum to 1, so a score is the log probability
of the whole text.

What follows two words is looked up in a shuffle of all (context, word) rows: it grows with the corpus
and nothing of it is held in one place. A text's own row is left out, so that learnt and held-out texts
are scored alike; without that every learnt text would be recited. A text gives a context one row, its
first continuation, so no context has more rows than there are texts, whatever is repeated inside them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgraph.llm import bytes as by
from inkgraph.llm.common import fold, small_batches
from inkgraph.plans.scratch import written

#: Words with a leaf of their own in the tree, at most (nodes have 16 bits); the others are spelt. Classes of the word before: the most frequent half, hashed endings.
COMMON, CLASSES = (1 << 16) - 2, 64
#: Tokens of the texts that are scored as one group, and of the contexts that one task looks up, about.
GROUP_TOKENS, PART_TOKENS = 400_000, 1_000_000
#: Bits of the first block of a text, doubled with every second block up to the last; share of a bit's gradient.
FIRST_BLOCK, LAST_BLOCK, RATE = 128, 8192, 0.008
#: Context lengths in bytes and slots of the tables for spelt words.
SPELT, SLOT_BITS = (1, 3), (17, 22)
_INPUTS, _GATES = 4, 42
_OWN_GATE, _FAR_GATE = 24, 30
_NODE = np.uint64(0xD6E8FEB86659FD93)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_END = np.uint64(0xA0761D6478BD642F)  # stands for the hash of the end sign
_OWN = np.array([[np.log((ones + 0.4) / (zeros + 0.4)) for ones in range(64)] for zeros in range(64)], dtype=np.float32).ravel()


# coding

@dataclass
class Tree:
    """A Huffman code. Of symbol k: nodes and bits at first[k] to first[k + 1]; odds: log odds of each node."""

    first: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray
    odds: np.ndarray

    def length(self, symbols: np.ndarray) -> np.ndarray:
        return self.first.take(symbols + 1) - self.first.take(symbols)

    def places(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in nodes and bits of the symbols' bits, one symbol after the other, and how many each has."""
        n = self.length(symbols)
        return np.arange(n.sum()) + np.repeat(self.first.take(symbols) - (np.cumsum(n) - n), n), n


def huffman(counts: np.ndarray) -> Tree:
    """One more than its count is a symbol's weight."""
    size = len(counts)
    heap = [(int(n) + 1, k) for k, n in enumerate(counts)]
    heapq.heapify(heap)
    parent, side, weight = np.zeros(2 * size - 1, np.int64), np.zeros(2 * size - 1, np.uint8), np.zeros(2 * size - 1)
    weight[:size] = np.asarray(counts) + 1.0
    for number in range(size, 2 * size - 1):
        (n, a), (m, b) = heapq.heappop(heap), heapq.heappop(heap)
        parent[[a, b]], side[b], weight[number] = number, 1, n + m
        heapq.heappush(heap, (n + m, number))
    ones = np.zeros(2 * size - 1)
    right = np.flatnonzero(side)
    ones[parent[right]] = weight[right]
    child, steps = np.arange(size), []
    while (child < 2 * size - 2).any():  # all symbols go up to the root, which is the last number
        steps.append(child)
        child = np.where(child < 2 * size - 2, parent[child], child)
    ways = np.stack(steps[::-1])
    inside = ways < 2 * size - 2
    n = inside.sum(axis=0)
    child = ways.T[inside.T]
    zeros = weight[size:] - ones[size:]
    return Tree(np.concatenate(([0], np.cumsum(n))), (parent[child] - size).astype(np.int32), side[child], np.log((ones[size:] + 0.3) / (zeros + 0.3)).astype(np.float32))


@dataclass
class Tokens:
    """The words of some texts and an end sign behind each text."""

    words: by.Words
    hash: np.ndarray
    word: np.ndarray  # number of the word, -1 for an end sign
    text: np.ndarray
    place: np.ndarray  # in the text
    bounds: np.ndarray  # of the texts

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> Tokens:
        words = by.Words(data, offsets)
        n = len(words.counts)
        bounds = np.concatenate(([0], np.cumsum(words.counts + 1)))
        text = np.repeat(np.arange(n), words.counts + 1)
        word, hashes = np.full(bounds[-1], -1), np.full(bounds[-1], _END)
        at = np.arange(len(words.first)) + words.owner()
        word[at], hashes[at] = np.arange(len(at)), words.hashes
        return cls(words, hashes, word, text, np.arange(bounds[-1]) - bounds[text], bounds)


def sorted_contexts(t: Tokens, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, token, first) of the tokens behind two others, by context, text and place; first: the text's first token with the context."""
    at = np.flatnonzero(t.place >= 2)
    context = by.mixed(t.hash[at - 2] * _A + t.hash[at - 1] * _B) >> np.uint64(64 - bits)
    room = max(1, len(t.hash).bit_length())
    if bits + room <= 64:
        both = np.sort((context << np.uint64(room)) | at.astype(np.uint64))
        context, at = both >> np.uint64(room), (both & np.uint64((1 << room) - 1)).astype(np.int64)
    else:
        order = np.argsort(context, kind="stable")
        context, at = context[order], at[order]
    first = np.ones(len(at), dtype=bool)
    first[1:] = (context[1:] != context[:-1]) | (t.text[at[1:]] != t.text[at[:-1]])
    return context, at, first


def next_class(hashes: np.ndarray) -> np.ndarray:
    """24 bits of a word, never 0."""
    return (hashes >> np.uint64(40)).astype(np.int64) | 1 << 23


def endings(words: by.Words) -> np.ndarray:
    """The class of each word by its last two bytes."""
    last = words.low[np.maximum(words.last - 1, 0)].astype(np.uint64)
    before = np.where(words.last - words.first > 1, words.low[np.maximum(words.last - 2, 0)], 0).astype(np.uint64)
    return CLASSES // 2 + (((last * np.uint64(256) + before) * _A) >> np.uint64(40)).astype(np.int64) % (CLASSES // 2)


@dataclass
class Lexicon:
    """The frequent words: hashes in ascending order, their symbols, counts and classes as a word before."""

    hashes: np.ndarray
    symbols: np.ndarray
    counts: np.ndarray
    classes: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray, counts: np.ndarray) -> Lexicon:
        order = np.argsort(hashes)
        hashes, counts = hashes[order], counts[order]
        rank = np.empty(len(order), np.int64)
        rank[np.lexsort((hashes, -counts))] = np.arange(len(order))
        return cls(hashes, rank, counts, np.where(rank < CLASSES // 2 - 1, rank + 1, 0))

    @cached_property
    def begins(self) -> tuple[int, np.ndarray, np.ndarray]:
        """(bits, where the hashes begin whose first bits are these or more, hashes with an end mark): about four places for each word, so a search takes a step or two."""
        bits = max(1, len(self.hashes).bit_length() + 2)
        sizes = np.bincount((self.hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        return bits, (np.cumsum(sizes) - sizes).astype(np.int32), np.append(self.hashes, np.uint64(0xFFFFFFFFFFFFFFFF))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether the word is there)."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        bits, begins, own = self.begins
        at = begins.take((hashes >> np.uint64(64 - bits)).astype(np.int64), mode="clip").astype(np.int64)
        behind = np.flatnonzero(own.take(at, mode="clip") < hashes)
        while len(behind):
            at[behind] += 1
            behind = behind[own.take(at[behind], mode="clip") < hashes[behind]]
        np.minimum(at, len(self.hashes) - 1, out=at)
        return at, self.hashes.take(at, mode="clip") == hashes

    def coded(self, t: Tokens, found: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(symbol of each token, class of the token before it). Behind the words come escape and end; class 0 is a text's beginning. found: what find() says of the words, where that is known."""
        size = len(self.hashes)
        place, known = self.find(t.words.hashes) if found is None else found
        is_word = t.word >= 0
        at, hit = np.zeros(len(t.hash), np.int64), np.zeros(len(t.hash), bool)
        at[is_word], hit[is_word] = place, known
        symbol = np.full(len(at), size)
        symbol[hit] = self.symbols[at[hit]]
        symbol[~is_word] = size + 1
        own = np.zeros(len(at), np.int64)
        own[is_word] = endings(t.words)
        if size:
            own = np.where(hit & (self.classes[at] > 0), self.classes[at], own)
        before = np.zeros(len(at), np.int64)
        before[1:] = own[:-1]
        before[t.place == 0] = 0
        return symbol, before


# corpus counts

def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place, count) of each distinct hash. Their first bits are sorted with their places in one number; where these bits do not tell all apart, the hashes themselves are."""
    room = np.uint64(max(1, int(len(hashes)).bit_length()))
    both = np.sort((hashes >> room << room) | np.arange(len(hashes), dtype=np.uint64))
    at = (both & ((np.uint64(1) << room) - np.uint64(1))).astype(np.int64)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (both[1:] >> room) != (both[:-1] >> room)
    full = hashes.take(at)
    if (~new[1:] & (full[1:] != full[:-1])).any():
        return np.unique(hashes, return_index=True, return_counts=True)[1:]
    start = np.flatnonzero(new)
    return at[start], np.diff(start, append=len(at))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, c) over what a task has read, in pieces."""
    def piece(words: list[by.Words]) -> pa.RecordBatch:
        hashes = np.concatenate([w.hashes for w in words])
        first, count = distinct(hashes)
        base = np.concatenate(([0], np.cumsum([len(w.hashes) for w in words])))
        which = np.searchsorted(base, first, side="right") - 1
        spelt = [words[k].low[words[k].first[j] : words[k].last[j]].tobytes() for k, j in zip(which.tolist(), (first - base[which]).tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(spelt, type=pa.binary()), pa.array(count)], names=["word", "c"])

    held: list[by.Words] = []
    size = 0
    for batch in batches:
        data, offsets = by.flat(batch.column(0))
        for first, last in by.steps(offsets, 1 << 20):
            part = offsets[first : last + 1]
            w = by.Words(data[part[0] : part[-1]], part - part[0])
            w.prefix = None
            if len(w.hashes):
                held.append(w)
                size += len(w.hashes)
            if size > 2_000_000:
                yield piece(held)
                held, size = [], 0
    if held:
        yield piece(held)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) of all words of a column of texts."""
    return texts.mapInArrow(_word_counts, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def word_hashes(column: pa.Array) -> np.ndarray:
    data, offsets = by.flat(column)
    return by.span_hash(by.prefix_hash(data), offsets[:-1], offsets[1:])


def _byte_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(256, np.int64)
    for batch in batches:
        data, offsets = by.flat(batch.column(0))
        total += np.bincount(data, minlength=256)
        total[32] += len(offsets) - 1
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], names=["key", "n"])


def closed(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, each closed by a space: their bytes, the place where each byte's word begins, and the words' sizes."""
    sizes = last - first + 1
    begin = np.cumsum(sizes) - sizes
    out = np.full(int(sizes.sum()), 32, dtype=np.uint8)
    inside = np.arange(int(sizes.sum() - len(sizes))) + np.repeat(np.arange(len(sizes)), sizes - 1)
    out[inside] = data[inside + np.repeat(first - begin, sizes - 1)]
    return out, np.repeat(begin, sizes), sizes


def spelt_events(tree: Tree, raw: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """(every bit, bits of each byte, slots in the tables, hash of the beginning of the word and node)."""
    place, reps = tree.places(raw)
    node = tree.nodes.take(place)
    prefix = by.prefix_hash(raw)
    at = np.arange(len(raw))
    mark = node.astype(np.uint64) * _NODE
    slots = []
    for k, bits in zip(SPELT, SLOT_BITS, strict=True):
        slots.append((((np.repeat(by.span_hash(prefix, np.maximum(start, at - k), at), reps) ^ mark) * _A) >> np.uint64(64 - bits)).astype(np.int64))
    return tree.bits.take(place), reps, slots, np.repeat(by.span_hash(prefix, start, at), reps) ^ (mark * _B)


def _spelt_counts(batches: Iterator[pa.RecordBatch], tree: Tree) -> Iterator[pa.RecordBatch]:
    """(key, n): a slot of the tables, doubled and with the bit added; every distinct word counts once."""
    size = 1 << SLOT_BITS[0]
    total = np.zeros(2 * (size + (1 << SLOT_BITS[1])), np.int32)
    for batch in batches:
        data, offsets = by.flat(batch.column(0))
        for a, b in by.steps(offsets, 1 << 17):
            raw, start, _ = closed(data, offsets[a:b], offsets[a + 1 : b + 1])
            bit, _, slots, _ = spelt_events(tree, raw, start)
            for k, slot in enumerate(slots):
                own, n = np.unique(2 * (slot + k * size) + bit, return_counts=True)
                total[own] += n.astype(np.int32)
    own = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own].astype(np.int64))], names=["key", "n"])


def _pairs(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    """(key, c): how often a symbol comes behind the class of a word; the key is class * symbols + symbol, so their number is bounded."""
    size = len(lexicon.hashes) + 2
    total = np.zeros(CLASSES * size, np.int64)
    for batch in batches:
        data, offsets = by.flat(batch.column(0))
        for a, b in by.steps(offsets, 1 << 21):
            symbol, before = lexicon.coded(Tokens.of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
            total += np.bincount(before * size + symbol, minlength=len(total))
    own = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], names=["key", "c"])


# what follows two words

def decided(context: np.ndarray, after: np.ndarray, learnt: np.ndarray) -> np.ndarray:
    """Of each row (context, word behind it, whether its text is learnt) what the other learnt texts say.

    0: nothing, as none of them has the context. Else 1, plus 1 if most of them have that word behind it
    (the smallest number where several words have as many), plus 2 * strength().
    """
    codes = np.zeros(len(context), np.uint8)
    if not len(context):
        return codes
    order = np.argsort((context << np.uint64(24)) | after.astype(np.uint64)) if int(context.max()) < 1 << 40 else np.lexsort((after, context))
    context, after, own = context[order], after[order], learnt[order].astype(np.int64)
    new_context = np.concatenate(([True], context[1:] != context[:-1]))
    new_pair = new_context | np.concatenate(([True], after[1:] != after[:-1]))
    pair_of, first = np.cumsum(new_pair) - 1, np.flatnonzero(new_pair)
    count = np.add.reduceat(own, first)
    group_of = (np.cumsum(new_context) - 1)[first]
    start = np.flatnonzero(new_context[first])
    total = np.add.reduceat(count, start)
    value = (count << 24) | (0xFFFFFF - after[first])
    best = np.maximum.reduceat(value, start)
    is_best = value == best[group_of]
    second = np.maximum.reduceat(np.where(is_best, 0, value), start)
    other = np.where(is_best, second[group_of], best[group_of])[pair_of]
    mine = value[pair_of] - (own << 24)
    hit = (mine > other) & (mine >> 24 > 0)
    k = np.where(hit, mine, other) >> 24
    n = total[group_of][pair_of] - own
    codes[order] = np.where(n > 0, 1 + hit + 2 * strength(k, n), 0)
    return codes


def strength(k: np.ndarray, n: np.ndarray) -> np.ndarray:
    """In 48 steps how many of n texts k are: 3 x (3 sizes of k) x 2 (all of them) x 8 (odds)."""
    odds = np.clip(np.log2((k + 0.4) / np.maximum(n - k + 0.4, 0.4)) + 4, 0, 7).astype(np.int64)
    return (np.clip(k, 1, 3) - 1) + 3 * (k == n) + 6 * odds


def _planes(values: np.ndarray, width: int) -> bytes:
    """The low bytes of numbers, all first bytes before all second ones, which shuffles compress well."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _numbers(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


@dataclass
class Group:
    """A group's tokens, in the order of its texts' ids, and what it asks the corpus: first continuations of contexts, and rare words."""

    tokens: Tokens
    context: np.ndarray
    at: np.ndarray
    first: np.ndarray
    rare: np.ndarray  # distinct hashes
    rare_counts: np.ndarray
    found: tuple[np.ndarray, np.ndarray]  # what the lexicon says of the words

    @classmethod
    def of(cls, texts: pa.Array, lexicon: Lexicon, bits: int) -> Group:
        t = Tokens.of(*by.flat(texts))
        context, at, first = sorted_contexts(t, bits)
        place, hit = lexicon.find(t.words.hashes)
        rare, counts = np.unique(t.words.hashes[~hit], return_counts=True)
        return cls(t, context, at, first, rare, counts, (place, hit))


def part_of(keys: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """Ranges of keys with so many bits: ascending with the keys."""
    top = keys >> np.uint64(bits - 32) if bits > 32 else keys << np.uint64(32 - bits)
    return ((top * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def _in_order(texts: pa.Table) -> pa.Table:
    return texts.sort_by("did")


def _questions(texts: pa.Table, lexicon: Lexicon, bits: int, parts: int) -> pa.Table:
    """(part, grp, kind, data): a group's rows for each part. Groups with odd numbers are held out."""
    texts = _in_order(texts)
    g = Group.of(texts.column("_text"), lexicon, bits)
    number = texts.column("grp")[0].as_py()
    context, after = g.context[g.first], next_class(g.tokens.hash[g.at[g.first]])
    rows = []
    for kind, keys, width, values, size in ((0, g.rare, 64, g.rare_counts, 8), (1, context, bits, after, 3)):
        part = part_of(keys, width, parts)
        edges = np.flatnonzero(np.diff(part, prepend=-1, append=parts))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            rows.append((int(part[a]), number, kind, _planes(keys[a:b], -(-width // 8)) + _planes(values[a:b], size)))
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.table([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.binary())], names=["part", "grp", "kind", "data"])


def _answers(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """From rows sorted by part and kind: (grp, part, kind, data) with the counts of rare words, and what is decided of contexts."""
    held: tuple | None = None
    rows: list[tuple[int, bytes]] = []

    def out() -> pa.RecordBatch:
        part, kind = held
        width = 8 if kind == 0 else -(-bits // 8)
        size = 8 if kind == 0 else 3
        sizes = [len(d) // (width + size) for _, d in rows]
        keys = np.concatenate([_numbers(d[: n * width], width) for (_, d), n in zip(rows, sizes, strict=True)])
        values = np.concatenate([_numbers(d[n * width :], size) for (_, d), n in zip(rows, sizes, strict=True)]).astype(np.int64)
        learnt = np.repeat([g % 2 == 0 for g, _ in rows], sizes)
        if kind == 0:
            _, inverse = np.unique(keys, return_inverse=True)
            answer = np.bincount(inverse, np.where(learnt, values, 0))[inverse].astype(np.uint64)
            packed = [_planes(x, 5) for x in np.split(answer, np.cumsum(sizes)[:-1])]
        else:
            packed = [x.tobytes() for x in np.split(decided(keys, values, learnt), np.cumsum(sizes)[:-1])]
        n = len(rows)
        return pa.RecordBatch.from_arrays([pa.array([g for g, _ in rows], pa.int64()), pa.array([part] * n, pa.int32()), pa.array([kind] * n, pa.int32()), pa.array(packed, pa.binary())], names=["grp", "part", "kind", "data"])

    for batch in batches:
        for part, group, kind, data in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if (part, kind) != held:
                if held is not None:
                    yield out()
                held, rows = (part, kind), []
            rows.append((group, data))
    if held is not None:
        yield out()


# mixing

@dataclass
class Model:
    lexicon: Lexicon
    tree: Tree  # over the frequent words, escape and end
    after: np.ndarray  # class of the word before x node: 4 times the log odds in 1/20, plus how much that has seen, 0 to 3
    letters: Tree
    spelt: list[np.ndarray]  # log odds by slot, in 1/1024
    weights: np.ndarray  # gate x input


def first_weights() -> np.ndarray:
    """The weights that every text begins with, by gate. Of match bits only the first and the last input count.

    They are what gradient steps over 150 learnt texts of the test data check_s came to, rounded to tenths, so figures on check_s are not
    independent of them. Nothing is fitted in a run.
    """
    out = np.zeros((_GATES, _INPUTS), dtype=np.float32)
    out[:_OWN_GATE] = [
        [1.0, 0.0, 0.1, 0.0], [0.4, 1.7, 0.1, 0.0], [0.4, 1.0, 0.1, 0.0], [0.4, 0.6, 0.1, 0.1],  # words, nothing seen in the text; by what was seen behind the word before
        [1.0, 0.0, 0.1, 0.0], [0.4, 1.3, 0.2, 0.0], [0.4, 0.9, 0.2, 0.0], [0.4, 0.6, 0.2, 0.0],  # seen once
        [1.0, 0.0, 0.1, 0.0], [0.4, 0.6, 0.1, 0.0], [0.4, 0.8, 0.1, 0.0], [0.4, 0.6, 0.3, -0.1],  # seen more often
        [0.1, 1.0, 0.1, 0.2], [0.2, 1.0, 0.1, 0.1], [0.4, 1.0, 0.1, 0.1], [0.4, 1.0, 0.1, 0.0],  # spelt words, in the same order
        [0.1, 0.8, 0.1, -0.3], [0.2, 0.7, 0.4, -0.2], [0.1, 0.6, 0.8, 0.0], [0.3, 0.8, 0.4, 0.0],
        [0.1, 0.6, 0.5, 0.0], [0.1, 0.3, 0.7, 0.0], [0.1, 0.3, 0.8, -0.1], [0.2, 0.6, 0.7, 0.0],
    ]
    out[_OWN_GATE:_FAR_GATE, 3] = [-1.4, -0.2, -0.5, 0.9, -0.6, 2.0]  # matches in the text: met once, twice, more often; each behind a miss and behind a hit
    out[_FAR_GATE:, 0] = [0.8, 0.7, -0.1, 1.2, 1.2, 1.1, 0.2, 1.3, 1.0, 1.5, 1.1, 2.1]  # matches in other texts
    out[_FAR_GATE:, 3] = [-2.3, -1.2, -1.1, 0.2, -2.0, -0.6, -0.5, 0.2, -0.8, 1.2, 0.0, 0.4]
    return out


def _own_history(key: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each event the log odds from earlier events with the same 32-bit key, and how many there are, 2 at most."""
    n = len(key)
    at = np.arange(n, dtype=np.int32)
    both = np.sort((key << np.uint64(32)) | (at.astype(np.uint64) << np.uint64(1)) | bit)  # sorting numbers is faster than finding their order
    halves = both.astype("<u8", copy=False).view("<u4").reshape(-1, 2)  # event and bit, key
    low, high = np.ascontiguousarray(halves[:, 0]), np.ascontiguousarray(halves[:, 1])
    order, ones = (low >> np.uint32(1)).astype(np.int64), (low & np.uint32(1)).view(np.int32)
    new = np.ones(n, dtype=bool)
    new[1:] = high[1:] != high[:-1]
    first = np.maximum.accumulate(at * new)
    before = np.cumsum(ones, dtype=np.int32) - ones
    before -= before.take(first, mode="clip")
    seen = at - first
    odds, many = np.empty(n, dtype=np.float32), np.empty(n, dtype=np.int8)
    odds[order] = _OWN.take(np.minimum(seen - before, 63) * 64 + np.minimum(before, 63), mode="clip")
    many[order] = np.minimum(seen, 2)
    return odds, many


@dataclass
class Matches:
    """Of each token: the gate of its match bit (-1: it has none), the log odds that the bit gets, the bit."""

    gate: np.ndarray
    odds: np.ndarray
    bit: np.ndarray


def matches(g: Group, codes: np.ndarray) -> Matches:
    """codes: what is decided of the group's first continuations, in the order of their contexts."""
    n = len(g.tokens.hash)
    gate, odds, bit = np.full(n, -1), np.zeros(n, np.float32), np.zeros(n, np.uint8)
    again = np.flatnonzero(~g.first)
    if len(again):
        at = g.at[again]
        run = np.arange(len(g.first)) - np.maximum.accumulate(np.where(g.first, np.arange(len(g.first)), 0))
        gate[at] = _OWN_GATE + 2 * (np.minimum(run[again], 3) - 1)
        bit[at] = g.tokens.hash[at] == g.tokens.hash[g.at[again - 1]]
    told = codes > 0
    at, code = g.at[g.first][told], codes[told].astype(np.int64) - 1
    bit[at] = code & 1
    code >>= 1
    gate[at] = _FAR_GATE + 4 * (code % 3) + 2 * (code // 3 % 2)
    odds[at] = (code // 6 - 3.5) * np.log(2.0)
    before = np.concatenate(([0], bit[:-1]))  # a text's first two tokens have no match bit
    gate[gate >= 0] += before[gate >= 0]
    return Matches(gate, odds, bit)


@dataclass
class Events:
    """All bits of some texts. x: log odds of the three predictors; place: where the texts' bits are in x, gate and bit; bits_of: offsets of the texts in place."""

    x: list[np.ndarray]
    gate: np.ndarray
    bit: np.ndarray
    place: np.ndarray
    bits_of: np.ndarray


def inputs(model: Model, t: Tokens, m: Matches, a: int, b: int) -> Events:
    """The bits of the tokens of the texts from a to b: match bits, then the words' trees, then spelt words."""
    first, last = int(t.bounds[a]), int(t.bounds[b])
    here = slice(first, last)
    symbol, before = (x[here] for x in t.coded)
    text = t.text[here] - a
    flag = np.flatnonzero(m.gate[here] >= 0)
    open_ = np.flatnonzero(m.bit[here] == 0)
    place, size = model.tree.places(symbol[open_])
    rare = open_[symbol[open_] == len(model.lexicon.hashes)]
    word = t.word[here][rare]
    raw, start, spelt = closed(t.words.low, t.words.first[word], t.words.last[word])
    spelt_bit, reps, slots, beginning = spelt_events(model.letters, raw, start)
    per_word = np.add.reduceat(reps, np.cumsum(spelt) - spelt) if len(rare) else np.zeros(0, np.int64)
    bits = np.zeros(last - first, np.int64)
    bits[flag] = 1
    in_tree = bits.copy()
    bits[open_] += size
    bits[rare] += per_word
    ends = np.cumsum(bits)
    begin = ends - bits
    in_tree += begin
    node, own_bit = model.tree.nodes.take(place, mode="clip"), model.tree.bits.take(place, mode="clip")
    at = [
        begin[flag],
        np.arange(len(place)) + np.repeat(in_tree[open_] - (np.cumsum(size) - size), size),
        np.arange(len(spelt_bit)) + np.repeat(begin[rare] + bits[rare] - per_word - (np.cumsum(per_word) - per_word), per_word),
    ]
    behind = model.after.take(np.repeat(before[open_] * len(model.tree.odds), size) + node, mode="clip")
    own, many = _own_history(np.repeat(text[open_].astype(np.uint64) << np.uint64(16), size) | node.astype(np.uint64), own_bit)
    far, near = (table.take(slot, mode="clip") * np.float32(1 / 1024) for table, slot in zip(model.spelt, slots, strict=True))
    key = np.repeat(by.mixed(np.arange(1, b - a + 1, dtype=np.uint64))[text[rare]], per_word) ^ beginning
    spelt_own, spelt_many = _own_history(key >> np.uint64(32), spelt_bit)
    none = np.zeros(len(flag), np.float32)
    x = [np.concatenate(parts) for parts in ((m.odds[here][flag], model.tree.odds.take(node, mode="clip"), far), (none, (behind >> 2) * np.float32(0.05), near), (none, own, spelt_own))]
    gate = np.concatenate((m.gate[here][flag].astype(np.int8), many * 4 + (behind & 3).astype(np.int8), 12 + spelt_many * 4 + np.minimum(3, np.abs(near)).astype(np.int8)))
    where = np.empty(len(gate), np.int64)
    where[np.concatenate(at)] = np.arange(len(gate))
    return Events(x, gate, np.concatenate((m.bit[here][flag], own_bit, spelt_bit)), where, np.concatenate(([0], ends[t.bounds[a + 1 : b + 1] - first - 1])))


def blocks(longest: int) -> Iterator[tuple[int, int]]:
    """(first bit, bits) of the blocks of a text."""
    at, k = 0, 0
    while at < longest:
        size = min(LAST_BLOCK, FIRST_BLOCK << (k // 2))
        yield at, size
        at += size
        k += 1


def mixed_bits(weights: np.ndarray, e: Events) -> np.ndarray:
    """Natural log probability of each text. Blocks of all texts go on side by side, each text with its own refinements.

    The last weight is that of a constant, 1 for match bits and 0.3 for others. A text refines one row of
    weights for its match bits and one for the others.
    """
    texts = len(e.bits_of) - 1
    lengths = np.diff(e.bits_of)
    total = np.zeros(texts)
    own = np.zeros((_INPUTS, texts, 2), dtype=np.float32)
    constant = np.where(np.arange(_GATES) < _OWN_GATE, 0.3, 1).astype(np.float32)
    # what the first weights give is the same in every block; refinements come to it
    fixed = (weights[:, -1] * constant).take(e.gate, mode="clip")
    for k, column in enumerate(e.x):
        fixed += weights[:, k].take(e.gate, mode="clip") * column
    signs = e.bit.astype(np.float32) * 2 - 1
    by_length = np.argsort(-lengths, kind="stable")
    for at, most in blocks(int(lengths.max(initial=0))):
        active = by_length[: np.count_nonzero(lengths > at)]
        first = e.bits_of[active] + at
        size = np.minimum(most, e.bits_of[active + 1] - first)
        begin = np.cumsum(size) - size
        place = e.place.take(np.repeat(first - begin, size) + np.arange(size.sum()), mode="clip")
        match = np.flatnonzero(e.gate.take(place, mode="clip") >= _OWN_GATE)
        of = active.take(np.searchsorted(begin, match, side="right") - 1)
        part = [column.take(place, mode="clip") for column in e.x]
        z = fixed.take(place, mode="clip")
        if at:
            by_match = z.take(match) + own[0, :, 1].take(of) * part[0].take(match) + own[-1, :, 1].take(of)
            for k, column in enumerate(part):
                z += np.repeat(own[k, active, 0], size) * column
            z += np.repeat(own[-1, active, 0] * constant[0], size)
            z[match] = by_match
        sign = signs.take(place, mode="clip")
        small = np.exp(-np.clip(z, -14, 14) * sign)
        both = 1 + small
        total[active] -= np.add.reduceat(np.log(both) + (small - (both - 1)) / both, begin, dtype=np.float64)  # log1p, which is slow; the second term gives back what 1 + small lost
        # only texts that go on, the first ones, need their slopes
        going = np.count_nonzero(lengths > at + most)
        if not going:
            break
        bits, active, begin = going * most, active[:going], begin[:going]
        wrong = sign[:bits] * small[:bits] / both[:bits]
        match = match[: np.searchsorted(match, bits)]
        of, by_match = of[: len(match)], wrong.take(match)
        wrong[match] = 0
        for k, column in enumerate(part):
            own[k, active, 0] += np.clip(RATE * np.add.reduceat(wrong * column[:bits], begin), -0.2, 0.2)
        own[-1, active, 0] += np.clip(RATE * constant[0] * np.add.reduceat(wrong, begin), -0.2, 0.2)
        for k, slope in ((0, by_match * part[0].take(match)), (-1, by_match)):
            own[k, :, 1] += np.clip(4 * RATE * np.bincount(of, slope, minlength=texts), -0.5, 0.5).astype(np.float32)
        np.clip(own, -3, 3, out=own)
    return total


def _steps(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts with so many bytes, and no more texts than 16 bits can number."""
    for a, b in by.steps(sizes, most):
        for c in range(a, b, 1 << 16):
            yield c, min(b, c + (1 << 16))


def log_probabilities(model: Model, g: Group, codes: np.ndarray, step_bytes: int = 1 << 17) -> np.ndarray:
    """Natural log probability of each text of a group."""
    t = g.tokens
    t.coded = model.lexicon.coded(t, g.found)
    m = matches(g, codes)
    sizes = np.concatenate(([0], np.cumsum(np.bincount(t.text[t.word >= 0], t.words.last - t.words.first, minlength=len(t.bounds) - 1)))).astype(np.int64)
    return np.concatenate([np.zeros(0), *(mixed_bits(model.weights, inputs(model, t, m, a, b)) for a, b in _steps(sizes, step_bytes))])


def _scores(texts: pa.Table, answers: pa.Table, model: Model, bits: int) -> pa.Table:
    """(doc_id, held_out, n_tokens, n_known, log_counts, n_bytes, score) of a group's texts."""
    texts = _in_order(texts)
    g = Group.of(texts.column("_text"), model.lexicon, bits)
    t = g.tokens
    answers = answers.sort_by([("kind", "ascending"), ("part", "ascending")])
    data = {k: [d for kind, d in zip(answers.column("kind").to_pylist(), answers.column("data").to_pylist(), strict=True) if kind == k] for k in (0, 1)}
    rare_counts = np.concatenate([np.zeros(0, np.uint64), *(_numbers(d, 5) for d in data[0])]).astype(np.int64)
    codes = np.frombuffer(b"".join(data[1]), np.uint8)
    place, hit = g.found
    counts = np.zeros(len(hit), np.int64)
    counts[hit] = model.lexicon.counts[place[hit]]
    counts[~hit] = rare_counts[np.searchsorted(g.rare, t.words.hashes[~hit])]
    n, owner = len(t.bounds) - 1, t.words.owner()
    score = log_probabilities(model, g, codes) / np.log(10)
    cols = [np.diff(t.bounds), np.bincount(owner, counts > 0, minlength=n).astype(np.int64), np.bincount(owner, np.log10(counts + 1.0), minlength=n), np.bincount(owner, t.words.last - t.words.first + 1, minlength=n).astype(np.int64) + 1, score]
    return pa.table([texts.column("doc_id"), texts.column("held_out"), *map(pa.array, cols)], names=["doc_id", "held_out", "n_tokens", "n_known", "log_counts", "n_bytes", "score"])


# the model of a corpus

def _summed(rows: DataFrame, size: int) -> np.ndarray:
    """Sums of (key, n) rows with keys under size, a number that does not grow with the input."""
    found = rows.groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[found.column("key").to_numpy()] = found.column("n").to_numpy()
    return out


def _letters(vocabulary: DataFrame) -> tuple[Tree, list[np.ndarray]]:
    """The byte tree and the tables for spelt words."""
    tree = huffman(_summed(vocabulary.select("word").mapInArrow(_byte_counts, "key long, n long"), 256))
    slots = _summed(vocabulary.select("word").mapInArrow(lambda it: _spelt_counts(it, tree), "key long, n long"), 2 * sum(1 << b for b in SLOT_BITS)).reshape(-1, 2)
    odds = (np.log((slots[:, 1] + 0.3) / (slots[:, 0] + 0.3)) * 1024).astype(np.int16)
    return tree, [odds[: 1 << SLOT_BITS[0]], odds[1 << SLOT_BITS[0] :]]


def _frequent(vocabulary: DataFrame) -> Lexicon:
    """The words of a count that COMMON words at most have: found from counts by eighths of a power of two."""
    step = F.floor(F.log2("c") * 8).cast("int")
    sizes = sorted(((r[0], r[1]) for r in vocabulary.groupBy(step.alias("step")).count().collect()), reverse=True)
    fits = [s for (s, _), total in zip(sizes, np.cumsum([n for _, n in sizes]), strict=True) if total <= COMMON]
    rows = vocabulary.where(step >= fits[-1]).toArrow() if fits else vocabulary.limit(0).toArrow()
    return Lexicon.of(word_hashes(rows.column("word")), rows.column("c").to_numpy().astype(np.int64))


def _after(pairs: DataFrame, tree: Tree, size: int) -> np.ndarray:
    """Log odds of the tree's nodes behind each class of words, and how much they have seen. At most CLASSES * COMMON pairs there are."""
    found = pairs.select(F.col("key").cast("int"), "c").toArrow()
    key, c = found.column("key").to_numpy(), found.column("c").to_numpy()
    order = np.argsort(key)
    edges = np.searchsorted(key, np.arange(CLASSES + 1) * size, sorter=order)
    nodes = len(tree.odds)
    out = np.zeros((CLASSES, nodes), np.int16)
    for k in range(CLASSES):
        own = order[edges[k] : edges[k + 1]]
        place, length = tree.places(key[own] % size)
        slot, n = 2 * tree.nodes.take(place) + tree.bits.take(place), np.repeat(c[own], length)
        zeros, ones = np.bincount(slot, n, minlength=2 * nodes).reshape(-1, 2).T
        out[k] = np.round(np.log((ones + 0.3) / (zeros + 0.3)) * 20).astype(np.int16) * 4 + np.searchsorted([1, 8, 64], zeros + ones, side="right")
    return out.ravel()


def score_texts(documents: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) of each row.

    Words of all rows whose fold is not `held` are learnt. Tokens: words, A-Z lower-cased, and one end.
    base_score: log10 of add-one unigram probabilities. score: log10 of the model's probability of the
    tokens; what follows two words is taken from the learnt rows other than the row itself. All counts come
    from all learnt texts; the weights that a text's blocks refine begin with fixed values.
    Null text counts as empty: its end alone. A null doc_id is in the fold of the empty text. Repeated
    rows are learnt and scored each for itself. Other columns are not read. No rows: no result. A task
    needs memory in proportion to the longest text.
    """
    spark = documents.sparkSession
    small_batches(spark)
    kind = documents.schema["doc_id"].dataType.simpleString()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), text.alias("_text"), F.xxhash64(F.col("doc_id"), text).alias("did"))
    training = rows.where("NOT held_out")
    vocabulary = written(word_counts(training.select("_text")), "vocabulary")
    n_texts = training.count()
    words, distinct = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, distinct = words + n_texts, distinct + (n_texts > 0)
    bits = min(60, max(34, total.bit_length() + 11))
    parts, groups = max(1, -(-total // PART_TOKENS)), max(1, -(-total // GROUP_TOKENS))

    lexicon = _frequent(vocabulary)
    size = len(lexicon.hashes) + 2
    by_symbol = np.zeros(size, np.int64)
    by_symbol[lexicon.symbols] = lexicon.counts
    by_symbol[-2:] = words - lexicon.counts.sum(), n_texts
    tree = huffman(by_symbol)
    letters, spelt = _letters(vocabulary)

    known = spark.sparkContext.broadcast(lexicon)
    pairs = training.select("_text").mapInArrow(lambda it: _pairs(it, known.value), "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))
    model = Model(lexicon, tree, _after(pairs, tree, size), letters, spelt, first_weights())

    shared = spark.sparkContext.broadcast(model)
    tasks = max(groups, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.withColumn("grp", F.pmod("did", F.lit(groups)) * 2 + F.col("held_out").cast("int")).repartition(tasks, "grp")
    questions = dealt.groupBy("grp").applyInArrow(lambda t: _questions(t, shared.value.lexicon, bits, parts), "part int, grp long, kind int, data binary")
    answers = questions.repartition(max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))), "part").sortWithinPartitions("part", "kind").mapInArrow(lambda it: _answers(it, bits), "grp long, part int, kind int, data binary")
    out = dealt.groupBy("grp").cogroup(answers.repartition(tasks, "grp").groupBy("grp")).applyInArrow(
        lambda texts, found: _scores(texts, found, shared.value, bits), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, log_counts double, n_bytes long, score double"
    )
    base = F.col("log_counts") + F.lit(float(np.log10(n_texts + 1.0))) - F.col("n_tokens") * F.lit(float(np.log10(total + distinct + 1.0)))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.lit(int(n_texts > 0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        "score",
        "n_bytes",
        (F.col("score") * F.lit(float(-np.log2(10.0))) / F.col("n_bytes")).alias("bits_per_byte"),
    )
