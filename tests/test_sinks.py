"""Checkpoints, metrics and logs written and read again."""

import pytest

from cuelake.operators import manifest, metrics
from cuelake.sources import sinks, subtitles, versioned

def test_checkpoints_written_and_resumed(spark, tmp_path):
    inputs = spark.createDataFrame(
        [("a", "h1", "m", 3, None), ("b", "h2", "m", 2, "k"), ("c", "h3", "m", 2, None)], "input string, source_sha256 string, model string, total int, translation_key string"
    )
    results = [("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z"), ("b", 1, None), ("c", 0, " "), ("c", 1, "late")]
    held = manifest.checkpoints(inputs, spark.createDataFrame(results, "input string, position int, translation string"))
    sinks.write_checkpoints(held, f"file://{tmp_path}/checkpoints")
    read = subtitles.read_checkpoints(spark, f"file://{tmp_path}/checkpoints")
    assert {(r["input"], r["version"], tuple(r["translations"])) for r in read.collect()} == {("a", 2, ("x", "y")), ("b", 3, ("z",))}
    found = {r["input"]: r["translations"] for r in manifest.usable_checkpoints(read.drop("input"), inputs).collect()}
    assert found == {"a": ["x", "y"], "b": ["z"], "c": []}
    (tmp_path / "checkpoints/bad.json").write_text("nonsense\n[]\n")
    assert subtitles.read_checkpoints(spark, f"file://{tmp_path}/checkpoints").count() == 2


def test_metrics_replace_those_before(spark, tmp_path):
    jobs = spark.createDataFrame([(1, "complete", True, 0.0, 5.0), (1, "failed", False, 2.0, 9.0)], "batch int, phase string, recognized boolean, started double, ended double")
    for _ in range(2):
        sinks.write_metrics(metrics.batch_metrics(jobs, "batch"), f"file://{tmp_path}/metrics")
    schema = "total long, failed long, unfinished long, exit_code long, recognized long, elapsed_seconds double"
    (row,) = versioned.read(spark, f"file://{tmp_path}/metrics", schema).collect()
    assert (row["total"], row["failed"], row["unfinished"], row["exit_code"], row["recognized"], row["elapsed_seconds"]) == (2, 1, 0, 1, 1, 9.0)


def test_log_is_appended(spark, tmp_path):
    for n in range(2):
        sinks.append_log(spark.createDataFrame([(n, "begun")], "time long, event string"), f"file://{tmp_path}/log")
    assert spark.read.json(f"file://{tmp_path}/log").count() == 2


def test_versions_hold_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    folder, schema = f"file://{tmp_path}/t", "n long"
    assert versioned.read(spark, folder, schema).collect() == []
    first = versioned.replace(spark.range(3).toDF("n"), folder)
    late = versioned.read(spark, folder, schema)
    with monkeypatch.context() as patch:
        patch.setattr(versioned, "put", lambda *_: (_ for _ in ()).throw(OSError("ended before the pointer moved")))
        with pytest.raises(OSError):
            versioned.replace(spark.range(9).toDF("n"), folder)
    assert versioned.read(spark, folder, schema).count() == 3 and versioned.pointer(folder)["version"] == first
    second = versioned.replace(spark.range(5).toDF("n"), folder, note={"upto": 7}, base=first, checked=True)
    assert versioned.pointer(folder) == {"upto": 7, "version": second, "form": "parquet"} and late.count() == 3
    with pytest.raises(RuntimeError):
        versioned.replace(spark.range(1).toDF("n"), folder, base=first, checked=True)
    versioned.replace(spark.range(6).toDF("n"), folder)
    assert versioned.read(spark, folder, schema).count() == 6 and len([x for x in (tmp_path / "t").iterdir() if x.is_dir()]) == 2
