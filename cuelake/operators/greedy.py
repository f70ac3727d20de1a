"""Greedy segments of consecutive words, worked out on arrays of many words at once.

A segment ends before the first word that would make its text too long, its time too long, or that follows a pause. For every word,
begun there, the first and the third end come from sums of lengths and from the places of pauses, looked up for all words together.
What is left to do one by one is a step a segment; ends in time are looked for in the few segments that may have one. The results are
those of ``sequence.segments_of``, to the last bit of their times.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cuelake.functions.text import CLOSERS, OPENERS, SPACES

#: Rows worked on at a time; arrays take some 150 bytes a word.
MOST_BYTES = 2 << 20
_CLOSERS, _OPENERS = pa.array(list(CLOSERS)), pa.array(list(OPENERS))


def is_cjk(language: str) -> bool:
    return language.startswith(("ja", "zh", "cmn", "yue"))


@dataclass
class Limits:
    max_chars: int
    max_seconds: float
    max_gap: float
    language: str

    def closes(self, text, begin: float, end: float, word: str, start: float, stop: float) -> bool:
        """Whether a word doesn't fit into the open segment (its ``sequence.TextJoin``, begin and end) any more."""
        return text.added(word)[1] > self.max_chars or stop - begin > self.max_seconds or start - end > self.max_gap


def as_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def changes(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Places whose value differs from the one before (the first place does)."""
    if not len(column):
        return np.zeros(0, np.int64)
    codes = as_array(column.dictionary_encode("encode")).indices.to_numpy()
    return np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))


class Words:
    """Words of files that lie one after another; ``firsts`` are the places where files begin."""

    def __init__(self, words: pa.Array, starts: np.ndarray, ends: np.ndarray, firsts: np.ndarray, limits: Limits):
        n = len(words)
        self.starts, self.ends, self.firsts, self.limits, self.n = starts, ends, firsts, limits, n
        # What is asked of single words is asked of each distinct one.
        held = as_array(words.fill_null("").dictionary_encode())
        self.codes, distinct = held.indices.to_numpy(), held.dictionary
        cjk = is_cjk(limits.language)
        self.parts = distinct if cjk else pc.utf8_trim(distinct, characters=SPACES)
        lengths = pc.utf8_length(self.parts).to_numpy().astype(np.int64)[self.codes]
        self.full = full = lengths > 0
        filled = np.flatnonzero(full)
        # A space before a word: not before closers, not after openers; whether it is a segment's first comes later.
        self.space = np.zeros(n, np.int64)
        if not cjk:
            clings, opens = (
                pc.is_in(pc.utf8_slice_codeunits(self.parts, *at), value_set=those).to_numpy(zero_copy_only=False)
                for at, those in (((0, 1), _CLOSERS), ((-1,), _OPENERS))
            )
            self.space[filled[1:]] = ~clings[self.codes[filled[1:]]] & ~opens[self.codes[filled[:-1]]]
        #: The first word from each on that isn't empty.
        self.filled_from = np.append(filled, n)[np.cumsum(full) - full]
        sizes = lengths + self.space
        self.sums = np.cumsum(sizes)
        #: What to take from the sums for the length of a text that begins at a word.
        self.before = self.sums - sizes + np.append(self.space, 0)[self.filled_from]
        over = np.maximum(np.searchsorted(self.sums, self.before + limits.max_chars, side="right"), np.arange(1, n + 1))
        with np.errstate(invalid="ignore"):
            breaks = np.concatenate((np.zeros(min(n, 1), bool), starts[1:] - ends[:-1] > limits.max_gap))
            breaks[firsts] = True
            #: Where a segment begun at a word ends at the latest.
            self.bound = np.minimum(over, np.append(np.flatnonzero(breaks), n)[np.cumsum(breaks)])
            falls = np.cumsum(np.concatenate((np.zeros(min(n, 1), bool), ~(ends[1:] >= ends[:-1]))))
            last = self.bound - 1
            # If ends rise, the last one tells whether any is late.
            late = (last > np.arange(n)) & (~(ends[last] - starts <= limits.max_seconds) | (falls[last] != falls))
        self.steps = np.where(late, -self.bound, self.bound).tolist()

    def following(self, at: int) -> int:
        """Where the segment after the one begun at a word begins."""
        bound = self.steps[at]
        if bound > 0:
            return bound
        begin, most = self.starts[at], self.limits.max_seconds
        for j in range(at + 1, -bound):
            if self.ends[j] - begin > most:
                return j
        return -bound

    def length(self, at: int, stop: int) -> int:
        """Length of the text of a segment."""
        return int(max(0, self.sums[stop - 1] - self.before[at]))

    def begins(self, at: int, stop: int) -> list[int]:
        """Where segments begin, from a word that begins one up to ``stop``, where a file ends (or the last one does)."""
        out, steps = [], self.steps
        while at < stop:
            out.append(at)
            bound = steps[at]
            at = bound if bound > 0 else self.following(at)
        return out

    def last(self, at: int, stop: int) -> str:
        """The last character of the text of a segment."""
        filled = np.flatnonzero(self.full[at:stop])
        return self.parts[int(self.codes[at + filled[-1]])].as_py()[-1] if len(filled) else ""

    def texts(self, begins: np.ndarray, stops: np.ndarray) -> pa.StringArray:
        """The texts of segments in order; words between one's stop and the next one's begin are in none."""
        if not len(begins):
            return pa.array([], pa.string())
        leads = self.space.copy()
        first = self.filled_from[begins]
        leads[first[first < self.n]] = 0
        # Every distinct word without and with a space before it.
        forms = pa.concat_arrays([self.parts, pc.binary_join_element_wise("", self.parts, " ")])
        codes, sizes = self.codes + leads * len(self.parts), stops - begins
        if begins[0] or (stops[:-1] != begins[1:]).any() or stops[-1] != self.n:
            inside = np.zeros(self.n + 1, np.int64)
            inside[begins] += 1
            inside[stops] -= 1
            codes = codes[np.cumsum(inside)[:-1] > 0]
        joined = forms.take(pa.array(codes))
        offsets = np.frombuffer(joined.buffers()[1], np.int32)[joined.offset : joined.offset + len(joined) + 1]
        cut = offsets[np.concatenate(([0], np.cumsum(sizes)))]
        return pa.StringArray.from_buffers(len(begins), pa.py_buffer(cut.tobytes()), joined.buffers()[2])


#: From rows the words of each (a list), and the starts and ends of all their words.
Spoken = Callable[[pa.RecordBatch], tuple[pa.ListArray, np.ndarray, np.ndarray]]


def spoken_columns(batch: pa.RecordBatch) -> tuple[pa.ListArray, np.ndarray, np.ndarray]:
    """Words and times that are there as columns of lists."""
    return batch.column("words"), *(batch.column(c).flatten().to_numpy() for c in ("starts", "ends"))


def first_places(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the lists that aren't empty, and where they begin among the values of all."""
    sizes = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    return np.flatnonzero(sizes), (np.cumsum(sizes) - sizes)[sizes > 0]


def spoken_parts(batch: pa.RecordBatch, spoken: Spoken) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows with words, about ``MOST_BYTES`` at a time: the rows, their words, starts and ends, and where each row begins."""
    step = max(1, int(batch.num_rows * MOST_BYTES / max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        words, starts, ends = spoken(part)
        rows, firsts = first_places(words)
        if len(rows):
            yield part.take(pa.array(rows)), words.flatten(), starts, ends, firsts


def segment_table(words: Words, files: pa.Array, first_number: int = 0) -> tuple[list[pa.Array], int]:
    """file, number, start, end and text of all segments; ``files`` are those at ``words.firsts``, the first one's count goes on. And where the last
    segment begins."""
    begins = np.array(words.begins(0, words.n), np.int64)
    stops = np.append(begins[1:], words.n)
    of = np.searchsorted(words.firsts, begins, side="right") - 1
    numbers = np.arange(len(begins)) - np.searchsorted(begins, words.firsts)[of]
    numbers[of == 0] += first_number
    times = words.starts[begins], words.ends[stops - 1]
    return [files.take(pa.array(of)), pa.array(numbers.astype(np.int32)), *map(pa.array, times), words.texts(begins, stops)], int(begins[-1])
