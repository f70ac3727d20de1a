"""Counts of files that are one row each, against the loop over segments."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cuelake.functions import text
from cuelake.operators import sequence

FILES = "file_id string, words array<string>, starts array<double>, ends array<double>"
SAID = ["a", "a", " a ", "b", "", "　", None, "(x)", "（x）", "[x", "MBC", "mbc!", "subscrİbe", "ſubscribe", "Subtitles by...", "SUBTITLES\nBY", "thank you for watching", "TB", "S", "点赞了", "Σ", "字幕制作…"]


@pytest.mark.parametrize("mode", ["off", "conservative", "aggressive"])
def test_texts_are_judged_as_by_the_column(spark, mode):
    wanted = spark.createDataFrame([(k, s) for k, s in enumerate(SAID)], "k int, s string").select("k", F.coalesce(text.is_hallucination(F.col("s"), mode), F.lit(True)))
    assert text.invented(pa.array(SAID), mode).tolist() == [r[1] for r in sorted(wanted.collect())]
    assert text.invented(pa.array([], pa.string()), mode).tolist() == []


@pytest.mark.parametrize("window", [0.1, 2.5, -1.0])
def test_counts_equal_the_loop(spark, window):
    pick, files = random.Random(5), [("none", [], [], []), ("null", None, None, None)]
    for k in range(80):
        n = pick.randint(1, 40)
        starts = [at * 1.0 + pick.choice([0, 0, 0.3]) for at in range(n)]
        files.append((f"f{k}", [pick.choice(SAID[: pick.choice([3, 5, len(SAID)])]) for _ in range(n)], starts, [s + pick.choice([1.0, 0.2, 2.0]) for s in starts]))
    invented = dict(zip(SAID, text.invented(pa.array(SAID), "aggressive").tolist()))
    rows = [(f, w, s, e, invented[w]) for f, *lists in files if lists[0] for w, s, e in zip(*lists)]
    found = sequence.summary_of_rows(spark.createDataFrame(files, FILES), mode="aggressive", window_seconds=window)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r)[:5] for r in found.collect()) == sorted(sequence.counts_of(iter(rows), window))


def test_documents_are_counted_where_they_are(spark):
    from cuelake.plans.queries import QUERIES

    assert "Exchange" not in QUERIES["transcription_summary"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
