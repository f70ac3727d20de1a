"""Long files from rows of many words each."""

import random

import numpy as np
import pyarrow as pa

from cuelake.operators import long_files, sequence


def test_rows_of_words_equal_the_loop(spark):
    pick, now, rows = random.Random(11), 0.0, []
    for at in range(90):
        starts = [now + 0.3 * k for k in range(pick.choice([0, 1, 7, 60]))]
        rows.append((f"f{at % 2}", at, [pick.choice(["a", "bb", ",", "(", "", "d" * 9]) for _ in starts], starts, [s + 0.2 for s in starts]))
        now += 0.3 * len(starts) + pick.choice([0.0, 2.0])
    given = spark.createDataFrame(rows, "file_id string, at long, words array<string>, starts array<double>, ends array<double>").repartition(4)
    loop = ((f, *w) for f, _, *lists in sorted(rows) for w in zip(*lists))
    wanted = sorted(sequence.segments_of(loop, 14, 4.0, 1.0, "en"))
    for ahead in (1, 96):
        found = long_files.segment_long_rows(given, max_chars=14, max_seconds=4.0, max_gap=1.0, language="en", chunk=16, ahead=ahead)
        assert sorted(map(tuple, found.collect())) == wanted


def test_tables_hold_only_places_where_a_segment_may_begin():
    limits = long_files.Limits(10, 1e9, 1.0, "en")
    words = pa.RecordBatch.from_arrays(
        [pa.array(["f"]), pa.array([["abc"] * 500]), pa.array([np.arange(500) * 0.5]), pa.array([np.arange(500) * 0.5 + 0.5])], names=["file_id", "words", "starts", "ends"]
    )
    laid = long_files._laid(words, 96, limits)
    # "abc abc" has 7 characters, a third word makes it 11.
    assert laid.column("head").to_pylist() == [["abc"] * 3] and laid.column("size").to_pylist() == [500]
