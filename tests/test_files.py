"""Facts read by position, and subtitle files written as transactions."""

import hashlib
import io
import json
import os
import subprocess
import sys
import wave
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cuelake.sources import positional, sinks, stores, subtitle_sink, subtitles

CUES = "file_id string, cue_index int, start_ms bigint, end_ms bigint, text string"
RENDERED = "file_id string, srt string"


def plain_identity(path, sample):
    raw = Path(path).read_bytes()
    tail = raw[-sample:] if len(raw) > sample else b""
    return len(raw), os.stat(path).st_mtime_ns, hashlib.sha256(str(len(raw)).encode() + raw[:sample] + tail).hexdigest()


def test_identities_and_hashes_by_plain_reading(spark, tmp_path):
    contents = {"empty": b"", "a": b"x" * 63, "b c%20": b"y" * 64, "c": b"z" * 65, "d": bytes(range(256)) * 9, "é字": b"n"}
    for name, raw in contents.items():
        (tmp_path / name).write_bytes(raw)
    paths = [(f"file:{tmp_path}/{name}",) for name in contents] + [(str(tmp_path / "a"),), (f"file://{tmp_path}/none",), (None,), (str(tmp_path),)]
    table = spark.createDataFrame(paths, "path string")
    found = [tuple(r) for r in positional.file_identities(table, sample=64).collect()]
    wanted = [(p, *plain_identity(p.removeprefix("file:"), 64), None) for (p,) in paths[:7]]
    wanted += [(paths[7][0], None, None, None, "FileNotFoundError"), (None, None, None, None, "ValueError"), (str(tmp_path), None, None, None, "FileNotFoundError")]
    assert sorted(found, key=repr) == sorted(wanted, key=repr)
    whole = {r["path"]: (r["size"], r["sha256"], r["error"]) for r in positional.file_hashes(table).collect()}
    assert all(whole[f"file:{tmp_path}/{n}"] == (len(raw), hashlib.sha256(raw).hexdigest(), None) for n, raw in contents.items())
    assert whole[None][2] == "ValueError" and whole[f"file://{tmp_path}/none"][2] == "FileNotFoundError"
    assert positional.file_identities(table.limit(0)).collect() == []


def test_changed_inputs_are_told(spark, tmp_path):
    for name in "abc":
        (tmp_path / name).write_bytes(name.encode() * 1000)
    table = spark.createDataFrame([(f"file:{tmp_path}/{n}",) for n in "abc"], "path string")
    before = spark.createDataFrame(positional.file_identities(table).drop("error").collect())
    (tmp_path / "b").write_bytes(b"b" * 999 + b"!")
    (tmp_path / "c").unlink()
    assert {r["path"][-1]: r["unchanged"] for r in positional.unchanged(before).collect()} == {"a": True, "b": False, "c": False}


BIG = """
import hashlib, resource, sys
from cuelake.sources import positional
from cuelake.sources.stores import locate
store, path = locate(sys.argv[1])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
print(*positional.sampled(store, path, 1 << 16), *positional.sound(store, path), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


def test_a_recording_of_3_gb_takes_no_memory(spark, tmp_path):
    """A sparse file with a sound's header: its ends and its last frame are read, in a task and in a process whose memory is measured."""
    frames = 3 << 29
    path = tmp_path / "long.wav"
    head = io.BytesIO()
    with wave.open(head, "wb") as file:
        file.setnchannels(1), file.setframerate(16000), file.setsampwidth(2)
    head = bytearray(head.getvalue())
    head[4:8], head[40:44] = (36 + 2 * frames).to_bytes(4, "little"), (2 * frames).to_bytes(4, "little")
    with path.open("wb") as file:
        file.write(head)
        file.truncate(len(head) + 2 * frames)
    size = len(head) + 2 * frames
    sample = hashlib.sha256(str(size).encode() + bytes(head) + bytes((1 << 16) - len(head)) + bytes(1 << 16)).hexdigest()
    table = spark.createDataFrame([(f"file:{path}",)], "path string")
    row = positional.sound_checks(positional.file_identities(table).drop("error")).first()
    assert (row["size"], row["sample_sha256"], row["frames"], row["sound_error"]) == (size, sample, frames, None)
    out = subprocess.run([sys.executable, "-c", BIG, str(path)], capture_output=True, text=True, check=True, timeout=60).stdout.split()
    assert out[0] == str(size) and out[2] == sample and out[3:5] == [str(frames), "None"] and int(out[5]) < 200
    with path.open("r+b") as file:
        file.truncate(size - 1)
    assert positional.sound_checks(table).first()["sound_error"] == "truncated"


def test_inputs_are_ordered_without_one_task(spark, tmp_path):
    names = [f"d{k % 3}/f{k:02}.MP4" for k in range(20)] + ["x.srt"]
    for name in names:
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"1")
    found = positional.ordered_inputs(spark, f"file://{tmp_path}").orderBy("number").collect()
    assert [r["number"] for r in found] == list(range(20))
    assert [r["path"] for r in found] == sorted(f"file:{tmp_path}/{n}" for n in names[:-1])


def test_subtitle_files_round_trip(spark, tmp_path):
    cues = [("a/one.srt", 1, 0, 900, "Hé"), ("a/one.srt", 2, 1000, 1900, "two\nlines"), ("b.srt", 1, 5, 3_600_000_000, "日本")]
    rendered = sinks.render(spark.createDataFrame(cues, CUES))
    out = subtitle_sink.write_subtitle_files(rendered, f"file://{tmp_path}/out").collect()
    assert {(r["file_id"], r["outcome"], r["backup"]) for r in out} == {("a/one.srt", "created", None), ("b.srt", "created", None)}
    assert (tmp_path / "out/b.srt").read_text(encoding="utf-8") == "1\n00:00:00,005 --> 1000:00:00,000\n日本\n\n"
    read = subtitles.read_cues(spark, f"file://{tmp_path}/out").collect()
    assert sorted((r["file_id"].partition("/out/")[2], *r[1:5]) for r in read) == cues
    assert not [p for p in tmp_path.rglob("*") if p.is_file() and (p.suffix == ".tmp" or ".staged" in str(p))]
    none = subtitle_sink.write_subtitle_files(rendered.limit(0), f"file://{tmp_path}/none")
    assert none.collect() == [] and subtitle_sink.announced(f"file://{tmp_path}/none") == []


def write(spark, folder, stamp="", **files):
    rows = spark.createDataFrame([(name.replace("_", "."), text) for name, text in files.items()], RENDERED)
    found = subtitle_sink.write_subtitle_files(rows, f"file://{folder}", stamp=stamp).collect()
    return {r["file_id"]: (r["outcome"], r["backup"]) for r in found}


def test_replaced_files_are_kept_under_names_of_their_own(spark, tmp_path):
    assert write(spark, tmp_path, "s1", x_srt="old") == {"x.srt": ("created", None)}
    assert write(spark, tmp_path, "s1", x_srt="new", y_srt=None) == {"x.srt": ("replaced", "x.backup.s1.srt"), "y.srt": ("created", None)}
    assert write(spark, tmp_path, "s1", x_srt="newer") == {"x.srt": ("replaced", "x.backup.s1.1.srt")}
    assert write(spark, tmp_path, "s1", x_srt="newer") == {"x.srt": ("unchanged", None)}
    assert write(spark, tmp_path, "", x_srt="last") == {"x.srt": ("replaced", None)}
    assert {p.name: p.read_text() for p in tmp_path.iterdir() if p.suffix == ".srt"} == {
        "x.srt": "last", "y.srt": "", "x.backup.s1.srt": "old", "x.backup.s1.1.srt": "new"}


@pytest.mark.parametrize("name", ["../x.srt", "/x.srt", "a/../../x.srt", "", None, "a//b", ".staged/x"])
def test_names_that_lead_elsewhere_fail_and_leave_nothing(spark, tmp_path, name):
    rows = spark.createDataFrame([("good.srt", "1"), (name, "2")], RENDERED)
    with pytest.raises(Exception, match="not a name below the folder"):
        subtitle_sink.write_subtitle_files(rows, f"file://{tmp_path}/out")
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]


def test_two_rows_of_a_name_refuse_the_run(spark, tmp_path):
    write(spark, tmp_path, x_srt="old")
    rows = spark.createDataFrame([("x.srt", "1"), ("y.srt", "2"), ("x.srt", "3")], RENDERED).repartition(3)
    with pytest.raises(ValueError, match="2 rows"):
        subtitle_sink.write_subtitle_files(rows, f"file://{tmp_path}")
    assert (tmp_path / "x.srt").read_text() == "old" and not (tmp_path / "y.srt").exists()
    assert subtitle_sink.recover(spark, f"file://{tmp_path}") == [] and not list((tmp_path / ".staged").iterdir())


def stage(spark, folder, run, rows, stamp="s"):
    spark.dataSource.register(subtitle_sink.SubtitleFiles)
    frame = spark.createDataFrame(rows, RENDERED)
    frame.write.format("subtitle_files").mode("append").option("run", run).option("stamp", stamp).save(f"file://{folder}")


def test_a_failing_task_leaves_the_old_files(spark, tmp_path):
    write(spark, tmp_path, a_srt="old")
    rows = spark.range(40).select(F.concat(F.col("id").cast("string"), F.lit(".srt")).alias("file_id"), F.expr("if(id = 33, raise_error('gone'), 'new')").alias("srt"))
    rows = rows.repartition(4).unionByName(spark.createDataFrame([("a.srt", "new")], RENDERED))
    with pytest.raises(Exception, match="gone"):
        subtitle_sink.write_subtitle_files(rows, f"file://{tmp_path}")
    assert [p.name for p in tmp_path.iterdir() if p.suffix == ".srt"] == ["a.srt"] and (tmp_path / "a.srt").read_text() == "old"
    assert not (tmp_path / ".staged").exists() or not list((tmp_path / ".staged").iterdir())


@pytest.mark.parametrize("steps", range(5))
def test_a_run_that_ended_anywhere_is_published_again(spark, tmp_path, steps):
    """Ends after every step of placing a file: nothing, backup copied, moved; and between files."""
    write(spark, tmp_path, a_srt="old a", b_srt="old b")
    stage(spark, tmp_path, "r1", [("a.srt", "new a"), ("b.srt", "new b"), ("c.srt", "new c")])
    assert subtitle_sink.announced(f"file://{tmp_path}") == ["r1"]
    store, root = stores.locate(f"file://{tmp_path}")
    lists = [json.loads(line) for p in sorted((tmp_path / ".staged/r1").rglob("list.jsonl")) for line in p.read_text().splitlines()]
    assert {(r["file_id"], r["backup"]) for r in lists} == {("a.srt", "a.backup.s.srt"), ("b.srt", "b.backup.s.srt"), ("c.srt", None)}
    by_name = {r["file_id"]: r for r in lists}
    if steps >= 1:
        subtitle_sink.put(store, f"{root}/a.backup.s.srt", b"old a")
    if steps >= 2:
        store.move(f"{root}/{by_name['a.srt']['staged']}", f"{root}/a.srt")
    if steps >= 3:
        subtitle_sink.put_in_place(store, root, by_name["c.srt"])
    if steps >= 4:
        subtitle_sink.put_in_place(store, root, by_name["b.srt"])
    assert subtitle_sink.recover(spark, f"file://{tmp_path}") == ["r1"]
    records = {(r["file_id"], r["backup"], r["outcome"]) for r in subtitle_sink.publish(spark, f"file://{tmp_path}", "r1").collect()}
    assert records == {("a.srt", "a.backup.s.srt", "replaced"), ("b.srt", "b.backup.s.srt", "replaced"), ("c.srt", None, "created")}
    texts = {p.name: p.read_text() for p in tmp_path.iterdir() if p.suffix == ".srt"}
    assert texts == {"a.srt": "new a", "b.srt": "new b", "c.srt": "new c", "a.backup.s.srt": "old a", "b.backup.s.srt": "old b"}
    assert subtitle_sink.announced(f"file://{tmp_path}") == [] and not list((tmp_path / ".staged").iterdir())


def test_a_file_changed_since_staging_is_left_alone(spark, tmp_path):
    write(spark, tmp_path, a_srt="old", b_srt="old")
    stage(spark, tmp_path, "r1", [("a.srt", "new"), ("b.srt", "new")])
    (tmp_path / "a.srt").write_text("by hand")
    found = {r["file_id"]: r["outcome"] for r in subtitle_sink.publish(spark, f"file://{tmp_path}", "r1").collect()}
    assert found == {"a.srt": "changed", "b.srt": "replaced"} and (tmp_path / "a.srt").read_text() == "by hand"


KILLED = """
import os, sys
from pyspark.sql import SparkSession
from cuelake.sources import subtitle_sink as sink
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
sink.publish = lambda *_: os._exit(9)
rows = spark.createDataFrame([(n + ".srt", "new") for n in "abc"], "file_id string, srt string").coalesce(1)
sink.write_subtitle_files(rows, sys.argv[1], stamp="s")
"""


def test_a_killed_driver_loses_nothing(spark, tmp_path):
    write(spark, tmp_path, a_srt="old", b_srt="old")
    done = subprocess.run([sys.executable, "-c", KILLED, f"file://{tmp_path}"], timeout=120, capture_output=True)
    assert done.returncode != 0 and (tmp_path / "a.srt").read_text() == "old"
    (run,) = subtitle_sink.recover(spark, f"file://{tmp_path}")
    found = {r["file_id"]: (r["outcome"], r["backup"]) for r in subtitle_sink.publish(spark, f"file://{tmp_path}", run).collect()}
    assert found == {"a.srt": ("replaced", "a.backup.s.srt"), "b.srt": ("replaced", "b.backup.s.srt"), "c.srt": ("created", None)}
    assert (tmp_path / "b.srt").read_text() == "new" and (tmp_path / "b.backup.s.srt").read_text() == "old"
