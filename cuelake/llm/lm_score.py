"""Language-model scores from a probabilistic suffix tree.

A text is a sequence of words (A-Z lowered) and one end. The tree reads it as symbols: the UTF-8
bytes of the words, a space between words, a line feed for the end. Contexts of variable length are
counted over all training rows:

* the last ``SHORT`` symbols or fewer, anywhere;
* the last ``DEPTH`` symbols or fewer where these reach over the beginning of the word;
* the whole word so far with the space before it, of any length beyond that.

A context is retained if it is frequent enough (``LEAST_COUNT`` times and once more for every
1 / ``LEAST_SHARE`` symbols of the corpus: the tree's least probability, at every size) and its next-symbol distribution diverges from that of its
longest counted suffix: count times Kullback-Leibler divergence, the nats it saves, must reach
``LEAST_GAIN``. All that pass are kept. At most 1 / ``LEAST_SHARE`` contexts of a length can, which
bounds the tree; until then it grows with the corpus. Its smoothed distributions are a file that
tasks map into memory, some 50 bytes a state; the driver writes it as it comes, block by block.
Distributions are smoothed towards those of the longest retained suffix. Each symbol is scored in
the state of its longest retained suffix; contexts run across words but not texts.

The contexts inside words follow from the counts of words, so only places near the beginning of a
word are counted over texts. Grams are summed in tasks before they are shuffled, once, to the part of
the tree that their nearest ``SHORT - 1`` symbols name; the number of parts follows the corpus.

The ``SYMBOLS - 1`` commonest bytes have symbols of their own; the others share one, under which
they are equally likely.

The base score is an add-0.1 unigram over words. Counts of all words are summed by shuffle. Words
frequent enough to be among ``MOST_HEAVY`` are looked up from a broadcast table of that many rows
at most; the rarer tokens of each text are joined to the counts by shuffle, one row per text and
word, so that no table that grows with the corpus is broadcast. Logarithms come from one expression and are
summed as multiples of 2 ** -36, so neither that division nor the order of sums shows in the score.

Defined results: a null text is empty and consists of the end; repeated rows are scored alone;
without training rows every word is unknown, N is 0 and all symbols are equally likely; other
columns are ignored.
"""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, materialise, slices, texts_as_bytes

SYMBOLS = 64
BITS = 6
SHORT = 4
DEPTH = 6
#: Depth by which contexts of a whole word's beginning go.
WORD = 7
LEAST_COUNT = 8
LEAST_SHARE = 1e-8
LEAST_GAIN = 8.0
#: Weight, in observations, of the shorter context's distribution.
SMOOTHING = 15.0
MOST_HEAVY = 100_000
#: Base logarithms are whole numbers of 1 / UNIT: exact sums for texts of ten million words.
UNIT = 1 << 36
#: Words, and grams, that a task sums up before it passes them on.
HELD_WORDS = 250_000
HELD_GRAMS = 2_000_000
WAITING_GRAMS = 600_000
#: Text whose symbols are worked on at a time; codes, states and logs take some 80 times as much, and should stay in a core's cache.
STREAM_BYTES = 1 << 18
#: Symbols of the corpus in a part of the tree, which one task tests; and how many parts there are at least.
PART_SYMBOLS = 8_000_000
PARTS = 8
#: Contexts in a block on their way to the driver.
BLOCK_STATES = 20_000

END = b"\n"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n and last: how often it stands, and how often as a text's last."""
    counts: Counter = Counter()
    last: Counter = Counter()

    def out():
        ended = [last.get(w, 0) for w in counts]
        batch = pa.RecordBatch.from_arrays(
            [pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64()), pa.array(ended, pa.int64())], names=["word", "n", "last"]
        )
        counts.clear()
        last.clear()
        return batch

    for batch in slices(batches, "text"):
        for text in texts_as_bytes(batch.column("text")):
            words = words_of(text)
            counts.update(words)
            last.update(words[-1:])
        if len(counts) > HELD_WORDS:
            yield out()
    if counts:
        yield out()


def symbol_table(byte_counts: dict[int, int]) -> np.ndarray:
    """Symbol of every byte: the space, the end and the commonest others have their own."""
    first = [32, 10]
    rest = sorted((b for b in range(256) if b not in first), key=lambda b: (-byte_counts.get(b, 0), b))
    out = np.full(256, SYMBOLS - 1, np.uint8)
    for symbol, byte in enumerate([*first, *rest[: SYMBOLS - 3]]):
        out[byte] = symbol
    return out


_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_FACTOR), -1, 1 << 64))


class Stream:
    """The symbols of texts, one after another, each with ``DEPTH`` ends before it.

    By place: seen (the symbol), codes (those of the ``DEPTH`` places before it, the nearest in the lowest
    bits), place (letters of its word before it) and scored (whether it belongs to a text). ``starts`` says
    where texts begin among the scored places.
    """

    def __init__(self, parts: list[bytes], symbols: np.ndarray):
        sizes = np.array([len(p) for p in parts], np.int64) + DEPTH
        self.bytes = np.frombuffer(b"".join(x for p in parts for x in (END * DEPTH, p)), np.uint8)
        n = len(self.bytes)
        self.seen = symbols[self.bytes].astype(np.uint64)
        self.codes = np.zeros(n, np.uint64)
        for back in range(1, DEPTH + 1):
            self.codes[back:] |= self.seen[: n - back] << np.uint64(BITS * (back - 1))
        is_break = (self.bytes == 32) | (self.bytes == 10)
        last = np.maximum.accumulate(np.where(is_break, np.arange(n), 0))
        self.begin = np.concatenate(([0], last[:-1]))
        self.place = np.arange(n) - self.begin - 1
        self.scored = np.ones(n, bool)
        begins = np.cumsum(sizes) - sizes
        for k in range(DEPTH):
            self.scored[begins + k] = False
        self.starts = begins - DEPTH * np.arange(len(parts))

    def keys(self, at: np.ndarray) -> np.ndarray:
        """A hash of 58 bits of the word so far, at some places: a polynomial of its symbols."""
        powers = np.full(len(self.seen), _INVERSE, np.uint64)
        powers[:1] = 1
        powers = np.multiply.accumulate(powers)
        sums = np.add.accumulate((self.seen + np.uint64(1)) * powers)
        upward = np.full(len(self.seen), _FACTOR, np.uint64)
        upward[:1] = 1
        upward = np.multiply.accumulate(upward)
        out = (sums[at - 1] - sums[self.begin[at]]) * upward[at - 1]
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
        return (out ^ (out >> np.uint64(32))) >> np.uint64(BITS)


class _Sums:
    """Weights summed by key, in bounded memory: new ones wait, up to a number, so that those held aren't sorted for each."""

    def __init__(self):
        self.keys, self.sums, self.new, self.waiting = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray, weights: np.ndarray | None = None) -> None:
        self.new.append(np.unique(keys, return_counts=True) if weights is None else (keys, weights))
        self.waiting += len(self.new[-1][0])
        if self.waiting > WAITING_GRAMS:
            self._merge()

    def _merge(self) -> None:
        keys, sums = zip((self.keys, self.sums), *self.new, strict=True)
        self.keys, self.sums = _summed(keys, sums)
        self.new, self.waiting = [], 0

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self._merge()
        found = self.keys, self.sums
        self.__init__()
        return found


_LOW = (1 << (BITS * (SHORT - 1))) - 1
#: What tasks pass on: keys, their counts and (of whole words) their last ``SHORT`` symbols, packed by the part of the
#: tree that the nearest ``SHORT - 1`` symbols of the context lie in. Kinds: a gram of ``DEPTH``, of ``SHORT``, of a whole word.
_PACKED = "part int, kind int, keys binary, counts binary, ups binary"
_OF_DEPTH, _OF_SHORT, _OF_WORD = range(3)
#: What parts give: retained contexts of a depth with their suffixes (of whole words) and next symbols; at depth 0 all grams of depth SHORT - 1.
_BLOCK = "depth int, contexts binary, ups binary, lengths binary, nexts binary, counts binary"


def _packed(kind: int, keys: np.ndarray, counts: np.ndarray, context: np.ndarray, parts: int, ups: np.ndarray | None = None) -> pa.RecordBatch:
    part = (((context & np.uint64(_LOW)) * _FACTOR) >> np.uint64(33)) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    found, begins = np.unique(part[order], return_index=True)
    cut = lambda x, kind: [y.tobytes() for y in np.split(x[order].astype(kind), begins[1:])]
    n = len(found)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(found.astype(np.int32)), pa.array([kind] * n, pa.int32()), pa.array(cut(keys, np.uint64), pa.binary()),
            pa.array(cut(counts, np.int64), pa.binary()), pa.array([None] * n if ups is None else cut(ups, np.uint32), pa.binary()),
        ],
        names=["part", "kind", "keys", "counts", "ups"],
    )


def _text_grams(symbols: np.ndarray, parts: int):
    """mapInArrow: grams of ``DEPTH`` symbols and the next at places near the beginning of a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()

        def out():
            keys, n = sums.take()
            return _packed(_OF_DEPTH, keys, n, keys >> np.uint64(BITS), parts)

        for batch in slices(batches, "text", STREAM_BYTES):
            stream = Stream([b" ".join(words_of(t)) + END for t in texts_as_bytes(batch.column("text"))], symbols)
            near = stream.scored & (stream.place < DEPTH - 1)
            sums.add((stream.codes[near] << np.uint64(BITS)) | stream.seen[near])
            if len(sums.keys) > HELD_GRAMS:
                yield out()
        if len(sums.keys) or sums.waiting:
            yield out()

    return run


def _word_grams(symbols: np.ndarray, parts: int):
    """mapInArrow over counted words: for places further into a word, grams of ``SHORT`` symbols and the next, and
    grams of the whole word so far and the next."""
    short = np.uint64((1 << (BITS * SHORT)) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, wholes = _Sums(), _Sums()
        held = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

        def out():
            nonlocal held
            keys, n = wholes.take()
            ups = held[1][np.searchsorted(held[0], keys >> np.uint64(BITS))]
            held = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
            yield _packed(_OF_WORD, keys, n, ups, parts, ups)
            keys, n = grams.take()
            yield _packed(_OF_SHORT, keys, n, keys >> np.uint64(BITS), parts)

        for batch in batches:
            words = batch.column("word").to_pylist()
            n, last = (batch.column(c).to_numpy() for c in ("n", "last"))
            # Words of such places: before a space, and as a text's last before the end.
            far = np.array([len(w) >= DEPTH - 1 for w in words], bool)
            spaced, ended = np.flatnonzero(far & (n > last)), np.flatnonzero(far & (last > 0))
            if not len(spaced) + len(ended):
                continue
            ends = [b" " + words[k] + b" " for k in spaced] + [b" " + words[k] + END for k in ended]
            stream = Stream(ends, symbols)
            weight = np.repeat(np.concatenate([(n - last)[spaced], last[ended]]), [len(x) + DEPTH for x in ends])
            at = np.flatnonzero(stream.scored & (stream.place >= DEPTH - 1))
            codes, seen, weight = stream.codes[at] & short, stream.seen[at], weight[at]
            keys = stream.keys(at)
            grams.add((codes << np.uint64(BITS)) | seen, weight)
            wholes.add((keys << np.uint64(BITS)) | seen, weight)
            every, first = np.unique(np.concatenate([held[0], keys]), return_index=True)
            held = every, np.concatenate([held[1], codes])[first]
            if len(wholes.keys) > HELD_GRAMS:
                yield from out()
        if len(wholes.keys) or wholes.waiting:
            yield from out()

    return run


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every, place = np.unique(np.concatenate([np.zeros(0, np.uint64), *keys]), return_inverse=True)
    return every, np.bincount(place, weights=np.concatenate([np.zeros(0), *counts]), minlength=len(every)).astype(np.int64)


def _shortened(grams: np.ndarray, counts: np.ndarray, depth: int, *more) -> tuple[np.ndarray, np.ndarray]:
    """Grams of contexts of ``depth`` symbols from longer ones, and others of that depth."""
    context = (grams >> np.uint64(BITS)) & np.uint64((1 << (BITS * depth)) - 1)
    keys = (context << np.uint64(BITS)) | (grams & np.uint64(SYMBOLS - 1))
    return _summed([keys, *(m[0] for m in more)], [counts, *(m[1] for m in more)])


def tested(grams: np.ndarray, counts: np.ndarray, ups: np.ndarray, shorter: tuple[np.ndarray, np.ndarray], least_count: float, least_gain: float):
    """Of contexts (from sorted grams, each with the context's suffix in ``shorter``) those that pass: their places as a mask over grams."""
    if not len(grams):
        return np.zeros(0, bool)
    context = grams >> np.uint64(BITS)
    begins = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
    sizes = np.diff(np.append(begins, len(grams)))
    totals = np.add.reduceat(counts, begins)
    frequent = np.repeat(totals >= least_count, sizes)
    total = np.repeat(totals, sizes)
    gains = np.zeros(len(grams))
    some = np.flatnonzero(frequent)
    other, of = shorter
    of_context = other >> np.uint64(BITS)
    edges = np.flatnonzero(np.concatenate(([True], of_context[1:] != of_context[:-1])))
    sums = np.add.reduceat(of, edges)
    wanted = (ups[some] << np.uint64(BITS)) | (grams[some] & np.uint64(SYMBOLS - 1))
    p = of[np.searchsorted(other, wanted)] / sums[np.searchsorted(of_context[edges], ups[some])]
    gains[some] = counts[some] * np.log(counts[some] / total[some] / p)
    return frequent & np.repeat(np.add.reduceat(gains, begins) >= least_gain, sizes)


def _block(depth: int, grams: np.ndarray, counts: np.ndarray, ups: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Contexts with their next symbols, ``BLOCK_STATES`` at a time."""
    context = grams >> np.uint64(BITS)
    begins = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(grams) else np.zeros(0, np.int64)
    for at in range(0, len(begins), BLOCK_STATES):
        first = begins[at : at + BLOCK_STATES]
        end = begins[at + BLOCK_STATES] if at + BLOCK_STATES < len(begins) else len(grams)
        lengths = np.diff(np.append(first, end)).astype(np.uint8)
        own = slice(int(first[0]), int(end))
        arrays = [context[first], ups[first], lengths, (grams[own] & np.uint64(SYMBOLS - 1)).astype(np.uint8), counts[own].astype(np.int64)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([depth], pa.int32()), *(pa.array([a.tobytes()], pa.binary()) for a in arrays)],
            names=["depth", "contexts", "ups", "lengths", "nexts", "counts"],
        )


def _test_part(least_count: float, least_gain: float):
    """mapInArrow over whole parts: the retained contexts of more than ``SHORT - 1`` symbols, and all grams of that many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, ups = ([[], [], []] for _ in range(3))
        for batch in batches:
            for kind, k, n, up in zip(*(batch.column(c).to_pylist() for c in ("kind", "keys", "counts", "ups")), strict=True):
                keys[kind].append(np.frombuffer(k, np.uint64))
                counts[kind].append(np.frombuffer(n, np.int64))
                if up is not None:
                    ups[kind].append(np.frombuffer(up, np.uint32))
        levels = {DEPTH: _summed(keys[_OF_DEPTH], counts[_OF_DEPTH])}
        short = _summed(keys[_OF_SHORT], counts[_OF_SHORT])
        for depth in range(DEPTH - 1, SHORT - 2, -1):
            levels[depth] = _shortened(*levels[depth + 1], depth, *([short] if depth == SHORT else []))
        for depth in range(SHORT, DEPTH + 1):
            grams, n = levels[depth]
            up = (grams >> np.uint64(BITS)) & np.uint64((1 << (BITS * (depth - 1))) - 1)
            kept = tested(grams, n, up, levels[depth - 1], least_count, least_gain)
            yield from _block(depth, grams[kept], n[kept], up[kept])
        yield from _block(0, *levels[SHORT - 1], np.zeros(len(levels[SHORT - 1][0]), np.uint64))
        if keys[_OF_WORD]:
            grams, n = _summed(keys[_OF_WORD], counts[_OF_WORD])
            every = np.concatenate(keys[_OF_WORD])
            order = np.argsort(every)
            up = np.concatenate(ups[_OF_WORD])[order][np.searchsorted(every[order], grams)].astype(np.uint64)
            kept = tested(grams, n, up, levels[SHORT], least_count, least_gain)
            yield from _block(WORD, grams[kept], n[kept], up[kept])

    return run


def retained_contexts(texts: DataFrame, counts: DataFrame, symbols: np.ndarray, parts: int, least_count: float, least_gain: float) -> DataFrame:
    """Blocks (``_BLOCK``) of the contexts that pass the test. All contexts that end in the same ``SHORT - 1`` symbols, and so
    all suffixes that longer ones are held against, are in one of the ``parts``; tasks have summed what they pass on."""
    near = texts.mapInArrow(_text_grams(symbols, parts), _PACKED)
    inside = counts.select("word", "n", "last").mapInArrow(_word_grams(symbols, parts), _PACKED)
    dealt = near.union(inside).repartitionById(parts, F.col("part"))
    return materialise(dealt.mapInArrow(_test_part(least_count, least_gain), _BLOCK), "contexts")


class _Table:
    """Values by key for many keys at once: a third of the slots is taken, the rest is found by the slots that follow."""

    NONE = np.uint64(0xFFFFFFFFFFFFFFFF)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, (3 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, self.NONE), np.zeros(1 << bits, np.uint32)
        left, at = np.arange(len(keys)), self._slots(keys)
        while len(left):
            free = np.flatnonzero(self.keys[at] == self.NONE)
            slots, first = np.unique(at[free], return_index=True)
            taken = free[first]
            self.keys[slots], self.values[slots] = keys[left[taken]], values[left[taken]]
            stays = np.ones(len(left), bool)
            stays[taken] = False
            left, at = left[stays], (at[stays] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (((keys ^ (keys >> np.uint64(31))) * _FACTOR) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places among ``keys`` of those that are there, and their values."""
        places, values = [], []
        left, at = None, self._slots(keys)
        while len(at):
            seen = self.keys[at]
            found = np.flatnonzero(seen == keys)
            places.append(found if left is None else left[found])
            values.append(self.values[at[found]])
            on = np.flatnonzero((seen != keys) & (seen != self.NONE))
            left, keys, at = on if left is None else left[on], keys[on], (at[on] + 1) & self.mask
        return np.concatenate([np.zeros(0, np.int64), *places]), np.concatenate([np.zeros(0, np.uint32), *values])


class SuffixTree:
    """Retained contexts, and the probabilities of their next symbols under smoothing.

    A state keeps the symbols seen after it as bits, where their probabilities begin among all states',
    the state of its longest retained suffix, and the weight of that for symbols not seen. State 0, the
    root's suffix, finds all symbols equally likely. Arrays lie one after another in one file.
    """

    _PARTS = (("bits", np.uint64), ("first", np.uint32), ("up", np.uint32), ("weight", np.float32), ("chance", np.float32))

    def __init__(self, blocks: DataFrame | None, symbols: np.ndarray, least_count: float = 0, least_gain: float = 0, smoothing: float = SMOOTHING):
        self.symbols, self._held, self._short, self._tables = symbols, None, None, {}
        #: depth -> (contexts in order, their states)
        self.levels: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        folder = tempfile.mkdtemp(prefix="spark-lm-")
        atexit.register(shutil.rmtree, folder, True)
        self.name = f"suffix-tree-{uuid.uuid4().hex}"
        self.path = f"{folder}/{self.name}"
        # Contexts of few symbols: at most 64 ** SHORT grams by their number of symbols, whatever the corpus.
        low = {SHORT - 1: _summed(*zip(*((g, n) for g, n, _ in self._read(blocks, 0)), strict=True))} if blocks is not None else {}
        for depth in range(SHORT - 2, -1, -1) if low else ():
            low[depth] = _shortened(*low[depth + 1], depth)
        states, edges = 1 + sum(len(g) for g, _ in low.values()), SYMBOLS + sum(len(g) for g, _ in low.values())
        if blocks is not None:
            more = blocks.where("depth > 0").agg(F.sum(F.octet_length("lengths")), F.sum(F.octet_length("nexts"))).first()
            states, edges = states + (more[0] or 0), edges + (more[1] or 0)
        self.room = (states, edges)
        np.memmap(self.path, np.uint8, "w+", shape=(20 * states + 4 * edges,)).flush()
        file = self._arrays("r+")
        file["bits"][0], file["chance"][:SYMBOLS] = np.uint64(0xFFFFFFFFFFFFFFFF), 1.0 / SYMBOLS
        size, filled = 1, SYMBOLS

        def add(depth: int, some: Iterator) -> None:
            nonlocal size, filled
            begun, contexts = size, []
            for grams, n, ups in some:
                if not len(grams):
                    continue
                context, seen = grams >> np.uint64(BITS), grams & np.uint64(SYMBOLS - 1)
                begins = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
                codes, row = context[begins], np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(grams))))
                shorter = self._shorter(depth, codes, ups[begins]) if depth else np.zeros(1, np.uint32)
                total = np.add.reduceat(n, begins) + smoothing
                own = slice(size, size + len(codes))
                file["bits"][own] = np.bitwise_or.reduceat(np.uint64(1) << seen, begins)
                file["first"][own] = filled + begins
                file["up"][own], file["weight"][own] = shorter, smoothing / total
                file["chance"][filled : filled + len(grams)] = (n + smoothing * self._chances(shorter[row], seen)) / total[row]
                contexts.append(codes)
                size, filled = own.stop, filled + len(grams)
            every = np.concatenate([np.zeros(0, np.uint64), *contexts])
            order = np.argsort(every)
            self.levels[depth] = every[order], (begun + order).astype(np.uint32)
            self._short = None

        self._held = file
        for depth in range(SHORT if low else 0):
            grams, n = low[depth]
            ups = (grams >> np.uint64(BITS)) & np.uint64((1 << (BITS * max(0, depth - 1))) - 1)
            kept = tested(grams, n, ups, low[depth - 1], least_count, least_gain) if depth else slice(None)
            add(depth, iter([(grams[kept], n[kept], ups[kept])]))
        for depth in range(SHORT, WORD + 1) if low else ():
            add(depth, self._read(blocks, depth))
        self.size = size
        for array in file.values():
            array.base.flush() if hasattr(array.base, "flush") else None

    @staticmethod
    def _read(blocks: DataFrame, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(grams, counts, suffixes) of each block of a depth, one partition at a time."""
        none = np.zeros(0, np.uint64)
        yield none, np.zeros(0, np.int64), none
        for b in blocks.where(F.col("depth") == depth).drop("depth").toLocalIterator():
            contexts, ups = (np.frombuffer(b[c], np.uint64) for c in ("contexts", "ups"))
            lengths = np.frombuffer(b["lengths"], np.uint8).astype(np.int64)
            nexts = np.frombuffer(b["nexts"], np.uint8).astype(np.uint64)
            yield (np.repeat(contexts, lengths) << np.uint64(BITS)) | nexts, np.frombuffer(b["counts"], np.int64), np.repeat(ups, lengths)

    def __getstate__(self):
        return {"symbols": self.symbols, "name": self.name, "levels": self.levels, "room": self.room, "size": self.size, "path": None, "_held": None, "_short": None, "_tables": {}}

    def _arrays(self, mode: str) -> dict[str, np.ndarray]:
        """The file's arrays: the driver's file or, in a task, that which ``SparkContext.addFile`` has brought."""
        raw, at, out = np.memmap(self.path or SparkFiles.get(self.name), np.uint8, mode), 0, {}
        for name, kind in self._PARTS:
            bytes_ = self.room[name == "chance"] * np.dtype(kind).itemsize
            out[name] = raw[at : at + bytes_].view(kind)
            at += bytes_
        return out

    def _chances(self, states: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """Probabilities of symbols in states: from the first state up the suffixes that has seen them."""
        if self._held is None:
            self._held = self._arrays("r")
        bits, first, up, weight, chance = (np.asarray(self._held[name]) for name, _ in self._PARTS)
        one = np.uint64(1)
        own, bit = bits[states], one << seen
        # Most symbols have been seen in their state; what is read for the others is put right below.
        out = chance.take(first[states] + np.bitwise_count(own & (bit - one)), mode="clip").astype(np.float64)
        left = np.flatnonzero((own & bit) == 0)
        out[left] = 1.0
        states, seen = states[left], seen[left]
        while len(left):
            out[left] *= weight[states]
            states = up[states]
            own, bit = bits[states], one << seen
            there = (own & bit) != 0
            at = states[there]
            out[left[there]] *= chance[first[at] + np.bitwise_count(own[there] & (bit[there] - one))]
            left, states, seen = left[~there], states[~there], seen[~there]
        return out

    def _override(self, states: np.ndarray, depth: int, codes: np.ndarray, at: np.ndarray | None = None) -> None:
        """States of that depth in place of shorter ones, where there are any."""
        contexts, own = self.levels.get(depth, ((), ()))
        if len(contexts):
            if depth not in self._tables:
                self._tables[depth] = _Table(contexts, own)
            found, values = self._tables[depth].find(codes)
            states[found if at is None else at[found]] = values

    def _short_states(self) -> np.ndarray:
        """State of every code of ``SHORT`` symbols: that of its longest retained suffix of so many at most."""
        if self._short is None:
            # Without any context all states are 0.
            table = np.zeros(1 << (BITS * SHORT), np.uint32)
            for depth in range(SHORT + 1):
                contexts, own = self.levels.get(depth, (np.zeros(0, np.uint64),) * 2)
                table.reshape(-1, 1 << (BITS * depth))[:, contexts.astype(np.int64)] = own
            self._short = table
        return self._short

    def _shorter(self, depth: int, codes: np.ndarray, ups: np.ndarray) -> np.ndarray:
        """States of the longest retained suffixes of contexts of one depth, all shorter ones being there."""
        codes = ups if depth == WORD else codes & np.uint64((1 << (BITS * (depth - 1))) - 1)
        states = self._short_states()[(codes & np.uint64((1 << (BITS * SHORT)) - 1)).astype(np.int64)].copy()
        if depth != WORD:
            for between in range(SHORT + 1, depth):
                self._override(states, between, codes & np.uint64((1 << (BITS * between)) - 1))
        return states

    def states(self, stream: Stream) -> np.ndarray:
        """State at every scored place."""
        at = np.flatnonzero(stream.scored)
        codes, place = stream.codes[at], stream.place[at]
        states = self._short_states()[(codes & np.uint64((1 << (BITS * SHORT)) - 1)).astype(np.int64)]
        near = np.flatnonzero(place < DEPTH - 1)
        for depth in range(SHORT + 1, DEPTH + 1):
            self._override(states, depth, codes[near] & np.uint64((1 << (BITS * depth)) - 1), near)
        far = np.flatnonzero(place >= DEPTH - 1)
        if len(self.levels.get(WORD, ((), ()))[0]):
            self._override(states, WORD, stream.keys(at[far]), far)
        return states

    def score(self, texts: list[list[bytes]]) -> np.ndarray:
        """Log10 probabilities of texts, given as words."""
        if not texts:
            return np.zeros(0)
        stream = Stream([b" ".join(words) + END for words in texts], self.symbols)
        seen = stream.seen[stream.scored]
        logs = np.log10(self._chances(self.states(stream), seen))
        logs[seen == SYMBOLS - 1] -= math.log10(max(1, int((self.symbols == SYMBOLS - 1).sum())))
        return np.add.reduceat(logs, stream.starts)


class LanguageModel:
    """counts: the table of training words (word, n); heavy: units by word; tokens and distinct count the end as a word."""

    def __init__(self, counts: DataFrame, tree: SuffixTree, heavy: dict[bytes, int], ends: int, tokens: int, distinct: int):
        self.counts, self.tree, self.heavy, self.ends, self.tokens, self.distinct = counts, tree, heavy, ends, tokens, distinct

    def units(self, n: Column) -> Column:
        """The base log10 of a token counted n times, in units."""
        return base_units(n, self.tokens, self.distinct)


def base_units(n: Column, tokens: int, distinct: int) -> Column:
    return F.round(F.log10((n + F.lit(0.1)) / F.lit(tokens + 0.1 * (distinct + 1))) * UNIT).cast("long")


def fit(docs: DataFrame, *, most_heavy: int = MOST_HEAVY, least_count: float = LEAST_COUNT, least_gain: float = LEAST_GAIN) -> LanguageModel:
    """Learn from all rows of ``docs``."""
    spark = docs.sparkSession
    texts = docs.select("text")
    counts = texts.mapInArrow(_word_counts, "word binary, n long, last long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("last").alias("last"))
    counts = materialise(counts, "word-counts")
    ends = docs.count()
    tokens, distinct, letters = counts.agg(F.sum("n"), F.count("*"), F.sum((F.octet_length("word") + 1) * F.col("n"))).first()
    octave = F.floor(F.log2("n") * 8)
    histogram = sorted(((r[0], r[1]) for r in counts.groupBy(octave).count().collect()), reverse=True)
    kept, cut = 0, None
    for at, n in histogram:
        if kept + n > most_heavy:
            break
        kept, cut = kept + n, at
    heavy = {}
    if cut is not None:
        units = base_units(F.col("n"), tokens + ends, distinct + 1)
        heavy = {bytes(w): u for w, u in counts.where(octave >= cut).select("word", units).toLocalIterator()}

    # Bytes of training words: at most 256 sums.
    bytes_seen = counts.select("word", "n").mapInArrow(_byte_counts, "byte int, n long").groupBy("byte").agg(F.sum("n")).collect()
    symbols = symbol_table(dict(bytes_seen))
    tree = SuffixTree(None, symbols)
    if ends:
        seen = (letters or 0) + ends
        least = least_count + math.floor(LEAST_SHARE * seen)
        blocks = retained_contexts(texts, counts, symbols, max(PARTS, math.ceil(seen / PART_SYMBOLS)), least, least_gain)
        tree = SuffixTree(blocks, symbols, least, least_gain)
    return LanguageModel(counts, tree, heavy, ends, (tokens or 0) + ends, distinct + (1 if ends else 0))


def _byte_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(256)
    for batch in batches:
        words = batch.column("word").to_pylist()
        seen = np.frombuffer(b"".join(words), np.uint8)
        weights = np.repeat(batch.column("n").to_numpy(), [len(w) for w in words])
        total += np.bincount(seen, weights=weights, minlength=256)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(256), pa.int32()), pa.array(total.astype(np.int64))], names=["byte", "n"])


_SCORED = "row long, n_tokens long, n_known long, base long, score double, rare array<struct<word: binary, k: long>>"


def score(docs: DataFrame, model: LanguageModel, *, carry: list[str]) -> DataFrame:
    """The columns ``carry``, n_tokens, n_known, base_score and score of every row."""
    from pyspark.sql.types import StructType

    base, end_known = model.heavy, int(model.ends > 0)
    end_log = docs.sparkSession.range(1).select(model.units(F.lit(model.ends))).first()[0]
    context = docs.sparkSession.sparkContext
    context.addFile(model.tree.path)
    held = context.broadcast((base, model.tree))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, tree = held.value
        for batch in slices(batches, "text", STREAM_BYTES):
            texts = [words_of(t) for t in texts_as_bytes(batch.column("text"))]
            sizes, known, sums, ends, rare, times = [], [], [], [0], [], []
            for words in texts:
                total, missing = end_log, 0
                for w, k in Counter(words).items():
                    log = base.get(w)
                    if log is None:
                        rare.append(w)
                        times.append(k)
                        missing += k
                    else:
                        total += log * k
                sizes.append(len(words) + 1)
                known.append(len(words) - missing + end_known)
                sums.append(total)
                ends.append(len(rare))
            pairs = pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(times, pa.int64())], names=["word", "k"])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
            out = [pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(sums, pa.int64()), pa.array(tree.score(texts)), lists]
            names = ["row", *carry, "n_tokens", "n_known", "base", "score", "rare"]
            row, *kept = (batch.column(c) for c in ["row", *carry])
            yield pa.RecordBatch.from_arrays([row, *kept, *out], names=names)

    own = StructType.fromDDL(_SCORED).fields
    rows = docs.select(F.monotonically_increasing_id().alias("row"), *carry, "text")
    schema = StructType([own[0], *(docs.schema[c] for c in carry), *own[1:]])
    scored = materialise(rows.mapInArrow(run, schema), "lm-scores")
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.k").alias("k"))
    n = F.coalesce("n", F.lit(0))
    sums = (
        rare.join(model.counts.select("word", "n"), "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("more_known"),
            F.sum(F.col("k") * model.units(n)).alias("more_base"),
        )
    )
    return (
        scored.drop("rare")
        .join(sums, "row", "left")
        .select(
            *carry,
            "n_tokens",
            (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
            ((F.col("base") + F.coalesce("more_base", F.lit(0))) / UNIT).alias("base_score"),
            "score",
        )
    )
