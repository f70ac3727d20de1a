"""Segmentation of files of any length, a chunk a task.

Greedy segments depend on all words before, yet little of that is left: where the segment that is open now began, how long its text is
and how it ends. A file is cut into chunks of words, and three passes give exactly what one loop over the file gives:

1. For every chunk it is found what becomes of a segment begun at each place where its first own segment may begin. The words up to the
   first that can't be in one text with the chunk's first word, by length or for a pause, are all such places, mostly a handful. Walks
   from them soon meet and then go on as one (at a pause at the latest). What is kept is, for each entry, the number of segments begun and the
   segment left open at the end.
2. The chain of a file's chunks is followed through these small tables alone: the segment open at a chunk's end closes among the first
   words of the next one, which gives that chunk's entry, its first number and the words that its predecessor's last segment takes
   over. Rows stream through; a task holds one chunk's table.
3. Every chunk makes its segments from its entry on.

Tables hold at most ``ahead`` words; files in which a chunk has more such places than that, and a segment that runs past them, are done
again with all of them, where nothing can be missed.

Words are sorted by ranges of (file, seq), so a file that holds most words is spread over as many tasks as its words deserve. Words with
equal file and seq are ordered by their times and text; null words count as empty. Rows that hold many words each are sorted as rows, and
their words found afterwards in the tasks that cut them into chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake import schemas
from cuelake.operators.greedy import Limits, Spoken, Words, as_array, changes, first_places, spoken_columns, spoken_parts
from cuelake.operators.sequence import MAX_CHARS, MAX_GAP, MAX_SECONDS, TextJoin
from cuelake.shared import materialise

#: Words in a chunk. Readers take some thousand rows at a time, so rows stay small: 16 KB or so.
CHUNK = 512
AHEAD = 96
#: Chunks in a batch.
MOST_CHUNKS = 64

_CHUNKS = "file_id string, words array<string>, starts array<double>, ends array<double>"
_TABLES = (
    "size int, head array<string>, head_starts array<double>, head_ends array<double>, "
    "counts array<int>, ending array<int>, begins array<double>, stops array<double>, lengths array<int>, lasts array<string>"
)
_FOLLOWED = f"file_id string, first long, {_TABLES}"
_ENTRIES = "file_id string, first long, entry int, number int, tail array<string>, tail_end double, failed boolean"


def _arrow(schema: str) -> pa.Schema:
    """The Arrow form of a schema string of the types used here."""
    plain = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.schema([(n, pa.list_(plain[t[6:-1]]) if t.startswith("array") else plain[t]) for n, t in fields])


def _batches(rows: Iterator[tuple], schema: str, most: int) -> Iterator[pa.RecordBatch]:
    fields = _arrow(schema)
    while some := list(islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), fields.types, strict=True)], schema=fields)


def _rows(batches: Iterator[pa.RecordBatch], names: str) -> Iterator[tuple]:
    """Rows of the named columns, some at a time as Python values, since a chunk's row is wide."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield from zip(*(part.column(c).to_pylist() for c in names.split()), strict=True)


def _names(schema: str) -> list[str]:
    return [f.split(" ")[0] for f in schema.split(", ")]


def _cut(files: pa.Array, words: pa.Array, starts: np.ndarray, ends: np.ndarray, begins: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    """Chunks of words that lie one after another; ``files`` are those of the stretches at ``begins``."""
    stops = np.append(begins[1:], len(words))
    cuts = [np.arange(b, e, size) for b, e in zip(begins.tolist(), stops.tolist(), strict=True)]
    of = np.repeat(np.arange(len(cuts)), [len(c) for c in cuts])
    cuts = np.append(np.concatenate(cuts), len(words))
    for at in range(0, len(of), MOST_CHUNKS):
        edges = cuts[at : at + MOST_CHUNKS + 1]
        own, offsets = slice(int(edges[0]), int(edges[-1])), pa.array((edges - edges[0]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, x) for x in (as_array(words[own]), pa.array(starts[own]), pa.array(ends[own]))]
        yield pa.RecordBatch.from_arrays([files.take(pa.array(of[at : at + MOST_CHUNKS])), *lists], names=_names(_CHUNKS))


def _pack_words(size: int) -> Callable:
    """Chunks of sorted rows of one word each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                files, words, starts, ends = (batch.column(c) for c in ("file_id", "word", "start", "end"))
                begins = changes(files)
                yield from _cut(files.take(pa.array(begins)), words, starts.to_numpy(), ends.to_numpy(), begins, size)

    return run


def _pack_rows(size: int, spoken: Spoken) -> Callable:
    """Chunks of sorted rows of many words each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, words, starts, ends, firsts in spoken_parts(batch, spoken):
                files = rows.column("file_id")
                begins = changes(files)
                yield from _cut(files.take(pa.array(begins)), words, starts, ends, firsts[begins], size)

    return run


def _sorted_words(words: DataFrame) -> DataFrame:
    order = ["file_id", "seq", "start", "end", "word"]
    ranged = words.select("file_id", F.col("seq").cast("long").alias("seq"), "start", "end", F.coalesce("word", F.lit("")).alias("word"))
    return ranged.repartitionByRange(*order).sortWithinPartitions(*order)


def chunks(words: DataFrame, size: int) -> DataFrame:
    """Rows of up to ``size`` words of one file, consecutive in it; first puts them in order."""
    return _sorted_words(words).mapInArrow(_pack_words(size), _CHUNKS).withColumn("first", F.monotonically_increasing_id())


def _walked(words: Words, begin: int, stop: int, entries: int) -> tuple:
    """What ``walk_all`` returns, for the chunk of ``words`` from begin to stop."""
    # Of each word at which a segment begins: how many begin from there on, and which is the last.
    known: dict[int, tuple[int, int]] = {}
    for at in range(begin, begin + entries):
        path = []
        while at < stop and at not in known:
            path.append(at)
            at = words.following(at)
        count, last = known[at] if at < stop else (0, path[-1] if path else None)
        for k, at in enumerate(reversed(path), 1):
            known[at] = count + k, last
    counts, lasts = zip(*(known[at] for at in range(begin, begin + entries)), strict=True)
    open_ = {at: k for k, at in enumerate(dict.fromkeys(lasts))}
    final = [(float(words.starts[at]), float(words.ends[stop - 1]), words.length(at, stop), words.last(at, stop)) for at in open_]
    return list(counts), [open_[at] for at in lasts], final


def walk_all(words: list[str], starts: list[float], ends: list[float], entries: int, limits: Limits) -> tuple:
    """For segments begun at each of the first ``entries`` words: how many begin in all, and which segment is open at the end.

    Returns counts and ending by entry, and the open segments that ending numbers (begin, end, length, last character).
    """
    held = Words(pa.array(words, pa.string()), np.array(starts, float), np.array(ends, float), np.zeros(1, np.int64), limits)
    return _walked(held, 0, held.n, entries)


def _laid(batch: pa.RecordBatch, ahead: int, limits: Limits) -> pa.RecordBatch:
    """Pass 1: chunks with their first words, and what becomes of a segment begun at each of them."""
    said, starts, ends = batch.column("words").flatten(), *(batch.column(c).flatten().to_numpy() for c in ("starts", "ends"))
    _, firsts = first_places(batch.column("words"))
    words = Words(said, starts, ends, firsts, limits)
    rows = []
    for begin, stop in zip(firsts.tolist(), [*firsts[1:].tolist(), words.n], strict=True):
        # No segment that is open at the begin goes on where one begun there couldn't, but for its time.
        n = min(ahead, abs(words.steps[begin]) + 1 - begin, stop - begin)
        counts, ending, final = _walked(words, begin, stop, n)
        own = slice(begin, begin + n)
        rows.append((stop - begin, said[own].to_pylist(), starts[own].tolist(), ends[own].tolist(), counts, ending, *map(list, zip(*final, strict=True))))
    fields = _arrow(_TABLES)
    laid = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), fields.types, strict=True)]
    return pa.RecordBatch.from_arrays([*batch.columns, *laid], names=[*batch.schema.names, *fields.names])


class OpenSegment(TextJoin):
    """The segment open at a chunk's end, of which only the length and the last character are known."""

    def __init__(self, language: str, begin: float, end: float, length: int, last: str):
        super().__init__(language)
        self.begin, self.end, self.length, self.last = begin, end, length, last


def follow(tables: Iterator[tuple], limits: Limits) -> Iterator[tuple]:
    """Pass 2 over the tables of files, each file's in order: a row of _ENTRIES for every chunk in which a segment begins."""
    file = open_ = held = None
    number, failed = 0, False

    def done() -> Iterator[tuple]:
        if held is not None:
            yield *held, False

    for this, first, size, words, starts, ends, counts, ending, begins, stops, lengths, lasts in tables:
        if this != file:
            yield from done()
            file, open_, held, number, failed = this, None, None, 0, False
        if failed:
            continue
        entry = 0
        if open_ is not None:
            while entry < len(words) and not limits.closes(open_, open_.begin, open_.end, words[entry], starts[entry], ends[entry]):
                open_.take(words[entry])
                open_.end = ends[entry]
                held[4].append(words[entry])
                held[5] = ends[entry]
                entry += 1
            if entry == len(words) < size:
                failed = True
                yield file, first, None, None, None, None, True
                held = None
                continue
            if entry == len(words):
                continue
        yield from done()
        k = ending[entry]
        held = [file, first, entry, number, [], None]
        number += counts[entry]
        open_ = OpenSegment(limits.language, begins[k], stops[k], lengths[k], lasts[k])
    yield from done()


def _segments(batch: pa.RecordBatch, limits: Limits) -> pa.RecordBatch:
    """Pass 3: the segments that begin in chunks (file_id, words, starts, ends, entry, number, tail, tail_end)."""
    said, starts, ends = batch.column("words").flatten(), *(batch.column(c).flatten().to_numpy() for c in ("starts", "ends"))
    _, firsts = first_places(batch.column("words"))
    words = Words(said, starts, ends, firsts, limits)
    entries, numbers = (batch.column(c).to_numpy().astype(np.int64) for c in ("entry", "number"))
    stops = [*firsts[1:].tolist(), words.n]
    walks = [words.begins(b, e) for b, e in zip((firsts + entries).tolist(), stops, strict=True)]
    sizes = np.array([len(w) for w in walks])
    begins = np.array([at for w in walks for at in w], np.int64)
    until = np.append(begins[1:], words.n)
    ending = np.cumsum(sizes) - 1
    # Words before the next chunk's entry go to the last segment here: see tails.
    until[ending] = stops
    stop_times, texts = ends[until - 1], words.texts(begins, until)
    tails = [(k, t, e) for k, t, e in zip(ending.tolist(), batch.column("tail").to_pylist(), batch.column("tail_end").to_pylist(), strict=True) if t]
    if tails:
        longer = []
        for k, tail, end in tails:
            text = TextJoin(limits.language)
            whole = texts[k].as_py()
            text.parts, text.length, text.last = [whole], len(whole), whole[-1:]
            for word in tail:
                text.take(word)
            longer.append("".join(text.parts))
            stop_times[k] = end
        mask = np.zeros(len(begins), bool)
        mask[[k for k, _, _ in tails]] = True
        texts = pc.replace_with_mask(texts, pa.array(mask), pa.array(longer, pa.string()))
    of = np.repeat(np.arange(len(sizes)), sizes)
    number = (np.arange(len(begins)) - (ending + 1 - sizes)[of] + numbers[of]).astype(np.int32)
    columns = [batch.column("file_id").take(pa.array(of)), pa.array(number), pa.array(starts[begins]), pa.array(stop_times), texts]
    return pa.RecordBatch.from_arrays(columns, names=["file_id", "seq", "start", "end", "text"])


_ENTERED = f"{_CHUNKS}, entry int, number int, tail array<string>, tail_end double"


def segments_from(row: tuple, limits: Limits) -> Iterator[tuple]:
    """The segments that begin in one chunk."""
    batch = next(_batches(iter([row]), _ENTERED, 1))
    yield from zip(*(c.to_pylist() for c in _segments(batch, limits).columns), strict=True)


def segment_long_files(
    words: DataFrame,
    *,
    max_chars: int = MAX_CHARS,
    max_seconds: float = MAX_SECONDS,
    max_gap: float = MAX_GAP,
    language: str = "ja",
    chunk: int = CHUNK,
    ahead: int = AHEAD,
) -> DataFrame:
    """As ``sequence.segment_words``, with every file spread over tasks: segments (file_id, seq, start, end, text)."""
    return _segmented(_sorted_words(words), _pack_words(chunk), Limits(max_chars, max_seconds, max_gap, language), chunk, ahead)


def segment_long_rows(
    rows: DataFrame,
    spoken: Spoken = spoken_columns,
    *,
    max_chars: int = MAX_CHARS,
    max_seconds: float = MAX_SECONDS,
    max_gap: float = MAX_GAP,
    language: str = "ja",
    chunk: int = CHUNK,
    ahead: int = AHEAD,
) -> DataFrame:
    """As ``segment_long_files`` of rows that hold many words each, in the order of their column ``at`` within a file_id.

    ``spoken`` finds them, as for ``sequence.segment_rows``.
    """
    ordered = rows.repartitionByRange("file_id", "at").sortWithinPartitions("file_id", "at")
    return _segmented(ordered, _pack_rows(chunk, spoken), Limits(max_chars, max_seconds, max_gap, language), chunk, ahead)


def _segmented(ordered: DataFrame, pack: Callable, limits: Limits, chunk: int, ahead: int) -> DataFrame:
    packed = ordered.mapInArrow(lambda b: (_laid(x, ahead, limits) for x in pack(b)), f"{_CHUNKS}, {_TABLES}")
    held = materialise(packed.withColumn("first", F.monotonically_increasing_id()), "word-chunks")

    def resolved(laid: DataFrame) -> DataFrame:
        names = _names(_FOLLOWED)
        laid = laid.select(*names).repartition("file_id").sortWithinPartitions("file_id", "first")
        return laid.mapInArrow(lambda b: _batches(follow(_rows(b, " ".join(names)), limits), _ENTRIES, 1024), _ENTRIES)

    def laid_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (b.slice(at, MOST_CHUNKS) for b in batches for at in range(0, b.num_rows, MOST_CHUNKS))
        return (_laid(p, chunk, limits) for p in parts)

    entries = materialise(resolved(held), "chunk-entries")
    failed = entries.where("failed").select("file_id").distinct()
    if failed.first() is not None:
        some = held.join(failed, "file_id", "left_semi").select(*_names(_CHUNKS), "first")
        again = materialise(resolved(some.mapInArrow(laid_again, f"{_CHUNKS}, first long, {_TABLES}")), "chunk-entries-again")
        entries = entries.join(failed, "file_id", "left_anti").unionByName(again)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (b.slice(at, MOST_CHUNKS) for b in batches for at in range(0, b.num_rows, MOST_CHUNKS))
        return (_segments(p, limits) for p in parts)

    joined = held.select(*_names(_CHUNKS), "first").join(entries.drop("file_id", "failed"), "first").select(*_names(_ENTERED))
    return joined.mapInArrow(run, schemas.SEGMENT)
