"""Segmentation by chunks against the loop over whole files."""

import random

import pytest
from pyspark.sql import functions as F

from cuelake.operators import long_files, sequence

WORDS = "file_id string, seq long, word string, start double, end double"


def speech(pick, n, pauses):
    """n words with or without pauses; pauses of 2 also let starts go back in time."""
    now, rows = 0.0, []
    for k in range(n):
        length = pick.random() * 0.4
        start = now - pick.random() if pauses == 2 else now
        rows.append((pick.choice(["a", "bb", "ccc", ",", "(", "", "  ", "dddddd", "字字", "e" * 30]), start, now + length))
        now += length + (pick.choice([0, 0, 0, 0.1, 0.9]) if pauses else 0.0)
    return rows


@pytest.mark.parametrize("trial", range(60))
def test_chunks_follow_one_another_as_the_loop_goes(trial):
    pick = random.Random(trial)
    limits = long_files.Limits(pick.choice([5, 25, 1000]), pick.choice([2.0, 6.0, 1e9]), pick.choice([0.5, 1e9]), pick.choice(["en", "ja"]))
    files = {f"f{k}": speech(pick, pick.randint(1, 120), pick.choice([0, 1, 2])) for k in range(3)}
    size = pick.choice([1, 3, 10, 40])
    chunks = [(name, at, *map(list, zip(*rows[at : at + size]))) for name, rows in files.items() for at in range(0, len(rows), size)]

    def tables(ahead):
        for name, at, words, starts, ends in chunks:
            n = min(ahead, len(words))
            counts, ending, final = long_files.walk_all(words, starts, ends, n, limits)
            yield name, at, len(words), words[:n], starts[:n], ends[:n], counts, ending, *map(list, zip(*final))

    found = []
    for name in files:
        entries = [e for e in long_files.follow(tables(pick.choice([1, 2, 5])), limits) if e[0] == name]
        if any(e[-1] for e in entries):
            entries = [e for e in long_files.follow(tables(size), limits) if e[0] == name]
        held = {(c[0], c[1]): c[2:] for c in chunks}
        for file, at, entry, number, tail, tail_end, failed in entries:
            assert not failed
            found += long_files.segments_from((file, *held[file, at], entry, number, tail, tail_end), limits)
    rows = ((name, *row) for name, own in files.items() for row in own)
    assert found == list(sequence.segments_of(rows, limits.max_chars, limits.max_seconds, limits.max_gap, limits.language))


@pytest.mark.parametrize("ahead", [2, 96])
def test_files_equal_the_loop(spark, ahead):
    pick = random.Random(7)
    rows = [(f"f{k}", s, *w) for k, n in enumerate((1, 40, 900)) for s, w in enumerate(speech(pick, n, k))]
    rows += [("null", 0, None, 0.0, 1.0), ("null", 1, "x", 1.0, 2.0)]
    words = spark.createDataFrame(rows, WORDS).repartition(5)
    options = dict(max_chars=12, max_seconds=2.0, max_gap=1.0, language="en")
    wanted = sorted(map(tuple, sequence.segment_words(words.fillna("", ["word"]), **options).collect()))
    assert sorted(map(tuple, long_files.segment_long_files(words, chunk=16, ahead=ahead, **options).collect())) == wanted
    assert long_files.segment_long_files(words.limit(0)).collect() == []


def test_a_million_words_without_a_pause(spark):
    """No task over its chunk: the file's words are spread over all ranges, and only tables of its chunks meet."""
    n = 1_000_000
    word = F.element_at(F.array(*map(F.lit, ["wort", "ein", "haus,", "(nichts", "unverhofft"])), (F.pmod(F.xxhash64("id"), F.lit(5)) + 1).cast("int"))
    words = spark.range(n).select(F.lit("f").alias("file_id"), F.col("id").alias("seq"), word.alias("word"), (F.col("id") * 0.25).alias("start"), (F.col("id") * 0.25 + 0.25).alias("end"))
    found = long_files.segment_long_files(words, max_chars=42, language="en")
    compare = sequence.segment_words(words, max_chars=42, language="en")
    rows = found.select("seq", "start", "end", "text").exceptAll(compare.select("seq", "start", "end", "text"))
    assert rows.count() == 0 and found.count() == compare.count() > 100_000
    sizes = long_files.chunks(words, 4096).select(F.size("words").alias("n"), F.spark_partition_id().alias("p"))
    assert sizes.agg(F.max("n")).first()[0] <= 4096
    assert sizes.groupBy("p").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] < n / 2
