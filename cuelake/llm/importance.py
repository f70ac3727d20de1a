"""Importance resampling towards a target text: hashed word features, log-ratio weights, and a Gumbel top-k draw.

Every run of 1 to ``most_words`` words of a text, joined by one space, falls into the bucket of its CRC-32. Two passes read the texts:
one counts buckets over the whole corpus and over the target, one sums each document's gains. Words are found and hashed by a byte
automaton over Arrow's UTF-8 buffers: a table classifies every byte, differences of neighbouring classes give the starts and ends of
words, and the CRCs of all words of a slice advance together, a byte a step.

What reaches the driver are the bucket counts (at most ``buckets`` rows) and a row a range of ranks. Ranks come from one range
shuffle of narrow rows (no text): a row's rank is its place in its range plus the rows of the ranges before. Equal scores and ids are
parted by the row's place in the table, so that rows with one id (null, say) spread like others.

Defined results: a null or empty text has no features, weight 0 and no rank (unless ``least_words`` is 0); a null id is hashed as the
empty text and comes after other ids among equal scores; repeated rows are rows of their own, with the same score and ranks of
their own; an empty corpus gives an empty result, an empty target gains that fall with a bucket's count alone; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, WORDS, materialise, slices

BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
#: Bytes of a word that advance together with those of all other words; the few longer words go on alone from there.
STEPS = 64

LOWERED = np.frombuffer(LOWER, np.uint8)
#: 1 for bytes of words.
CLASS = (np.frombuffer(WORDS, np.uint8) != 32).astype(np.int8)


def crc_table() -> np.ndarray:
    """What a byte does to the CRC-32 register (reflected polynomial 0xEDB88320)."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC = crc_table()


@dataclass(frozen=True)
class Words:
    """Words of a column of texts: lowered bytes of all texts, starts and lengths of words, and the text each word belongs to."""

    data: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    text: np.ndarray


def find_words(column: pa.Array) -> Words:
    """Where the words are. A word ends with its text, however the next one begins."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = CLASS[data]
    step = np.diff(inside)
    # Where two texts meet within a run of word bytes, one word ends and another starts.
    met = np.unique(bounds)
    met = met[(inside[met] == 1) & (inside[met + 1] == 1)]
    starts = np.sort(np.concatenate([np.flatnonzero(step == 1), met]))
    ends = np.sort(np.concatenate([np.flatnonzero(step == -1), met]))
    return Words(LOWERED[data], starts, ends - starts, np.searchsorted(bounds, starts, "right") - 1)


def advance(register: np.ndarray, words: Words, which: np.ndarray) -> np.ndarray:
    """The CRC registers after the bytes of the words ``which``, all of them a byte a step."""
    lengths = words.lengths[which]
    order = np.argsort(np.minimum(lengths, STEPS).astype(np.uint8), kind="stable")[::-1]
    at = words.starts[which][order]
    state = register[order]
    alive = len(at) - np.cumsum(np.bincount(np.minimum(lengths, STEPS), minlength=STEPS + 1))
    for j in range(STEPS):
        if not alive[j]:
            break
        now = state[: alive[j]]
        state[: alive[j]] = CRC[(now ^ words.data[at[: alive[j]] + j]) & 255] ^ (now >> 8)
    for k in np.flatnonzero(lengths[order] > STEPS):
        rest = words.data[at[k] + STEPS : at[k] + lengths[order[k]]]
        state[k] = zlib.crc32(rest.tobytes(), int(state[k]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(state)
    out[order] = state
    return out


def features(column: pa.Array, most_words: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of one word, of two, and so on: the text and the bucket of each run."""
    words = find_words(column)
    first = np.arange(len(words.starts))
    register = advance(np.full(len(first), 0xFFFFFFFF, np.uint32), words, first)
    for n in range(1, most_words + 1):
        if n > 1:
            # A run of n words is one of n - 1, a space and the next word of the same text.
            last = np.minimum(first + n - 1, len(words.starts) - 1)
            keep = (first + n - 1 == last) & (words.text[first] == words.text[last])
            first, register = first[keep], register[keep]
            register = CRC[(register ^ 32) & 255] ^ (register >> 8)
            register = advance(register, words, first + n - 1)
        yield words.text[first], (register ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)


def bucket_counts(texts: DataFrame, *, most_words: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """bucket and n of the features of column ``text`` over all rows. Each task sends one row a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches, "text"):
            for _, bucket in features(batch.column("text"), most_words, buckets):
                total += np.bincount(bucket, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])

    counted = texts.select("text").mapInArrow(count, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, target: DataFrame, *, most_words: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket: 1000 times the log ratio of its smoothed shares in the target and in the corpus, floored."""
    counts = []
    for table in (docs, target):
        n = np.zeros(buckets, np.int64)
        for row in bucket_counts(table, most_words=most_words, buckets=buckets).collect():
            n[row["bucket"]] = row["n"]
        counts.append(n)
    s, t = counts
    ratio = (t + 1.0) * float(s.sum() + buckets) / ((s + 1.0) * float(t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, *, carry: list[str], most_words: int = 1) -> DataFrame:
    """The columns ``carry``, __words, __features (their numbers) and __weight (the sum of the features' gains) of every row."""
    kept = docs.select(*(F.col(c) for c in carry), F.col("text").alias("__text"))
    own = [f for f in kept.schema.fields if f.name != "__text"]
    added = ["__words", "__features", "__weight"]

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            counts, weight = [], np.zeros(batch.num_rows, np.int64)
            for text, bucket in features(batch.column("__text"), most_words, len(gains)):
                counts.append(np.bincount(text, minlength=batch.num_rows))
                sums = np.concatenate([[0], np.cumsum(gains[bucket])])
                weight += np.diff(sums[np.searchsorted(text, np.arange(batch.num_rows + 1))])
            columns = [batch.column(f.name) for f in own] + [pa.array(x) for x in (counts[0], sum(counts), weight)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in own] + added)

    schema = kept.select(*(f.name for f in own), *(F.lit(0).cast("long").alias(name) for name in added)).schema
    return kept.mapInArrow(weights, schema)


def noise(doc_id: Column, seed: int) -> Column:
    """A Gumbel variate in thousandths, from a hash of the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    *,
    most_words: int = 1,
    buckets: int = BUCKETS,
    seed: int = SEED,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is null where it isn't drawn."""
    gains = fit(docs, target, most_words=most_words, buckets=buckets)
    weighed = weigh(docs.select("doc_id", "text"), gains, carry=["doc_id"], most_words=most_words)
    scored = weighed.select(
        "doc_id",
        (F.col("__words") < least_words).alias("out"),
        F.col("__features").alias("n_features"),
        F.col("__weight").alias("weight"),
        (F.col("__weight") + noise(F.col("doc_id"), seed)).alias("score"),
        F.monotonically_increasing_id().alias("at"),
    )
    # Texts are read once more for the range bounds unless the narrow rows are written first.
    scored = materialise(scored, "importance-scores")
    order = [F.col("out").asc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("at").asc()]
    ranged = scored.repartitionByRange(*order).sortWithinPartitions(*order)
    # The id's upper bits number the range, its lower 33 bits the rows in it.
    ranged = materialise(ranged.withColumn("place", F.monotonically_increasing_id()).drop("at"), "importance-ranks")
    part = F.shiftright("place", 33)
    sizes = ranged.groupBy(part.alias("part")).agg(F.count("*").alias("rows"), F.count_if(~F.col("out")).alias("able")).orderBy("part").collect()
    before, total = [], 0
    for row in sizes:
        before.append((row["part"], total))
        total += row["rows"]
    drawn = sum(row["able"] for row in sizes) * percent // 100
    offsets = docs.sparkSession.createDataFrame(before, "part long, before long")
    place = F.col("place").bitwiseAND((1 << 33) - 1)
    rank = F.col("before") + place + 1
    return (
        ranged.join(F.broadcast(offsets), part == F.col("part"))
        .select("doc_id", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))
    )
