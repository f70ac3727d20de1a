"""Benchmark decontamination with a generalised suffix automaton.

The normalised test items are put into one suffix automaton over word numbers. Every document is
then streamed through it: at each word the automaton holds the longest stretch ending there that
occurs in some item. A stretch of ``window`` words, or a whole item shorter than that, is an
occurrence; all words inside occurrences are hit. A document is contaminated once its hit words
reach the coverage limit.

Defined results: a null or empty text has no words, no hits and isn't contaminated. Items without
words, null ones included, never match. Repeated documents or items are judged one by one; an
item id that occurs twice counts once, and items without an id are left out, as a hit couldn't name them. Extra columns of either table are ignored.

Items are handled in blocks of at most ``block_words`` words, so the broadcast automaton has a
fixed size whatever the benchmark grows to; with more than one block the documents are scanned
once for each, and the hit words are united by row. Cleaned texts are cut from the united spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import WORDS, materialise, slices, texts_as_bytes

WINDOW = 13
#: A document is contaminated if hit words * COVERAGE >= words.
COVERAGE = 20
#: Words of test items in one automaton: at most twice as many states, some 100 MB of Python.
BLOCK_WORDS = 200_000

WORD_PLACES = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


class ItemAutomaton:
    """Suffix automaton of word sequences, with the items of every window on its states."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.window = window
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        texts = []
        for item, text in items:
            words = [self.number.setdefault(w, len(self.number)) for w in text.translate(WORDS).split()]
            if words:
                texts.append((item, words))
                self._add(words)
        #: state -> items with a full window whose shortest-suffix state this is
        self.full: dict[int, set[str]] = {}
        #: state -> {length: items} for whole items shorter than a window
        self.short: dict[int, dict[int, set[str]]] = {}
        for item, words in texts:
            if len(words) < window:
                state = 0
                for w in words:
                    state = self.next[state][w]
                self.short.setdefault(state, {}).setdefault(len(words), set()).add(item)
            else:
                state = 0
                for at, w in enumerate(words):
                    state = self.next[state][w]
                    if at + 1 >= window:
                        state = self._holding(state, window)
                        self.full.setdefault(state, set()).add(item)
        self.shortest = min((min(window, len(w)) for _, w in texts), default=0)
        #: the nearest state with a short item on the way up the suffix links, itself excluded
        self.above = [-1] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            up = self.link[state]
            self.above[state] = up if up in self.short else self.above[up]

    def _holding(self, state: int, length: int) -> int:
        """The state of the suffix of ``length`` words of what ``state`` stands for."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def _add(self, words: list[int]) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for w in words:
            if w in nxt[last]:
                q = nxt[last][w]
                if length[q] == length[last] + 1:
                    last = q
                else:
                    last = self._split(last, w, q)
                continue
            state = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and w not in nxt[p]:
                nxt[p][w] = state
                p = link[p]
            if p != -1:
                q = nxt[p][w]
                link[state] = q if length[p] + 1 == length[q] else self._split(p, w, q)
            last = state

    def _split(self, p: int, w: int, q: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = copy
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def occurrences(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit stretches [from, to) of word places, merged and in order, and the items they come from."""
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        n = len(words)
        if not self.shortest or n < self.shortest:
            return spans, found
        ids = np.fromiter(map(self.number.get, words, repeat(-1)), np.int32, n)
        # Only stretches of known words can hold an occurrence.
        edges = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False])).astype(np.int8)))
        for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if end - begin >= self.shortest:
                self._walk(ids[begin:end].tolist(), begin, spans, found)
        return spans, found

    def _walk(self, ids: list[int], offset: int, spans: list[tuple[int, int]], found: set[str]) -> None:
        nxt, link, length, window = self.next, self.link, self.length, self.window
        state = size = 0
        for at, w in enumerate(ids, offset + 1):
            while state and w not in nxt[state]:
                state = link[state]
                size = length[state]
            if w in nxt[state]:
                state = nxt[state][w]
                size += 1
            longest = 0
            if size >= window:
                here = self._holding(state, window)
                if here in self.full:
                    found |= self.full[here]
                    longest = window
            if self.short:
                here = state
                while here > 0:
                    for m, items in self.short.get(here, {}).items():
                        if m <= size:
                            found |= items
                            longest = max(longest, m)
                    here = self.above[here]
            if longest:
                begin = at - longest
                while spans and spans[-1][1] >= begin:
                    begin = min(begin, spans.pop()[0])
                spans.append((begin, at))


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str, bytes]]]:
    """Items with an id and a text, in blocks bounded by words; one partition at a time reaches the driver."""
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("binary"))
    for item, text in rows.where("item_id is not null and text is not null").toLocalIterator():
        n = len(bytes(text).translate(WORDS).split())
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append((item, bytes(text)))
        size += n
    yield block


def _without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    places = [m.span() for m in WORD_PLACES.finditer(text)]
    out, at = [], 0
    for begin, end in spans:
        out.append(text[at : places[begin][0]])
        at = places[end - 1][1]
    return b"".join([*out, text[at:]])


def _matcher(automaton, columns: list[str], text_column: str, clean: bool):
    """mapInArrow function: the given columns, then n_words, spans, item_ids and cleaned_text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = automaton.value.occurrences
        for batch in slices(batches, text_column):
            counts, spans, items, texts = [], [], [], []
            for text in texts_as_bytes(batch.column(text_column)):
                words = text.translate(WORDS).split()
                hit, found = find(words)
                counts.append(len(words))
                spans.append([{"from": a, "to": b} for a, b in hit])
                items.append(sorted(found))
                if clean:
                    texts.append(_without(text, hit).decode("utf-8", "replace") if hit else None)
            span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
            out = [pa.array(counts, pa.int64()), pa.array(spans, span), pa.array(items, pa.list_(pa.string()))]
            names = ["__n_words", "__spans", "__items"]
            if clean:
                out.append(pa.array(texts, pa.string()))
                names.append("__cleaned")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *out], names=[*columns, *names])

    return run


def _cleaner(columns: list[str], text_column: str):
    """mapInArrow function: the given columns, then __cleaned from __spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_column):
            texts = texts_as_bytes(batch.column(text_column))
            spans = ([(s["from"], s["to"]) for s in found] for found in batch.column("__spans").to_pylist())
            cleaned = [_without(t, s).decode("utf-8", "replace") if s else None for t, s in zip(texts, spans, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(cleaned, pa.string())], names=[*columns, "__cleaned"])

    return run


_RESULT = "__n_words long, __spans array<struct<from: long, to: long>>, __items array<string>"


def _merged(lists):
    """One list of spans in order, those that touch or overlap joined."""

    def joined(done, span):
        last = F.element_at(done, -1)
        longer = F.struct(last["from"].alias("from"), F.greatest(last["to"], span["to"]).alias("to"))
        return F.when(
            (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["to"] >= span["from"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer)),
        ).otherwise(F.concat(done, F.array(span)))

    none = F.array().cast("array<struct<from: long, to: long>>")
    return F.aggregate(F.array_sort(F.flatten(lists)), none, joined)


def find_overlap(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    carry: list[str] | None = None,
    text_column: str = "text",
    window: int = WINDOW,
    coverage: int = COVERAGE,
    block_words: int = BLOCK_WORDS,
    clean: bool = False,
) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all, other than those named here, if it isn't given) and,
    for every row, n_words, n_hit, spans (word places [from, to)), item_ids (sorted as strings),
    contaminated and, with ``clean``, cleaned_text: the text without its hit words (null: it has none).
    """
    spark = docs.sparkSession
    own = {"n_words", "n_hit", "spans", "item_ids", "contaminated", "cleaned_text"}
    columns = [c for c in (carry or docs.columns) if c not in own]
    docs = docs.select(*columns, *([] if text_column in columns else [text_column]))
    fields = [docs.schema[c] for c in columns]
    blocks = _blocks(benchmark, block_words)
    held = next(blocks)
    following = next(blocks, None)
    if following is None:
        automaton = spark.sparkContext.broadcast(ItemAutomaton(held, window))
        found = docs.mapInArrow(
            _matcher(automaton, columns, text_column, clean),
            StructType(fields + StructType.fromDDL(_RESULT + ", __cleaned string" * clean).fields),
        )
    else:
        # Rows need a key to be united by, the same in every scan.
        docs = materialise(docs.withColumn("__row", F.monotonically_increasing_id()), "decontaminate")
        parts = None
        while held:
            automaton = spark.sparkContext.broadcast(ItemAutomaton(held, window))
            scan = docs.select("__row", text_column).mapInArrow(
                _matcher(automaton, ["__row"], text_column, False), f"__row long, {_RESULT}"
            )
            part = materialise(scan, "overlap")
            automaton.unpersist()
            parts = part if parts is None else parts.unionByName(part)
            held, following = following, next(blocks, None)
        united = parts.groupBy("__row").agg(
            F.max("__n_words").alias("__n_words"),
            _merged(F.collect_list("__spans")).alias("__spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("__items")))).alias("__items"),
        )
        found = docs.join(united, "__row").drop("__row")
        if clean:
            kept = [*columns, "__n_words", "__spans", "__items"]
            schema = StructType([*fields, *StructType.fromDDL(_RESULT + ", __cleaned string").fields])
            found = found.select(*kept, F.col(text_column).alias("__text")).mapInArrow(_cleaner(kept, "__text"), schema)
    n_hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda a, s: a + s["to"] - s["from"])
    return (
        found.withColumn("__n_hit", n_hit)
        .select(
            *columns,
            F.col("__n_words").alias("n_words"),
            F.col("__n_hit").alias("n_hit"),
            F.col("__spans").alias("spans"),
            F.col("__items").alias("item_ids"),
            ((F.col("__n_hit") > 0) & (F.col("__n_hit") * coverage >= F.col("__n_words"))).alias("contaminated"),
            *([F.col("__cleaned").alias("cleaned_text")] if clean else []),
        )
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with the columns of ``docs`` alone."""
    return find_overlap(docs, benchmark, **options).where(~F.col("contaminated")).select(docs.columns)
