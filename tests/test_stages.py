import json

import pytest
from pyspark.sql import functions as F

from cuelake import settings
from cuelake.operators import stages

RESULTS = "batch string, stage string, success boolean, error string, segments int, status int, free_bytes long"


def test_transitions_and_pauses(spark):
    rows = [
        ("a", "extract", True, None, None, None, 10**12),
        ("a", "stt", True, None, 3, None, None),
        ("a", "stt", True, None, 0, None, None),
        ("a", "translate", True, None, None, 200, None),
        ("b", "extract", False, "OSError: No space left on device", None, None, None),
        ("b", "translate", False, "refused", None, 401, None),
        ("c", "stt", False, "CUDA out of memory", None, None, None),
        ("d", "extract", True, None, None, None, 1000),
    ]
    results = spark.createDataFrame(rows, RESULTS)
    assert [r["phase"] for r in stages.advance(results).collect()] == [
        "audio_ready", "source_ready", "no_text", "complete", "pending", "failed", "failed", "audio_ready",
    ]
    paused = {r["batch"]: (r["extract_paused"], r["translate_paused"]) for r in stages.pauses(results).collect()}
    assert paused == {"a": (False, False), "b": (True, True), "c": (False, False), "d": (True, False)}
    assert [r[0] for r in results.select(stages.is_fatal(F.col("error"))).collect()].count(True) == 1


def test_settings(tmp_path):
    path = tmp_path / "settings.json"
    assert settings.load(path) == settings.Settings()
    path.write_text("﻿" + json.dumps({"batch": 5, "sleep": 2, "retries": "many", "output_mode": "loud", "other": 1}), encoding="utf-8")
    found = settings.load(path)
    assert (found.batch, found.sleep, found.retries, found.output_mode) == (5, 2.0, 3, "bilingual")
    settings.save(found, path)
    assert settings.load(path) == found and [p.name for p in tmp_path.iterdir()] == ["settings.json"]
    for bad in ('{"provider": "x"}', "[]"):
        path.write_text(bad)
        with pytest.raises(ValueError):
            settings.load(path)
