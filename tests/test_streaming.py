import random
import time

import pytest
from pyspark.sql import functions as F

from cuelake.operators.state_table import StateTable
from cuelake.sources import versioned
from cuelake.streaming import breaker, events, timers


def test_late_attempts_are_fenced_across_batches(spark, tmp_path):
    schema = "job_id string, attempt_no long, seq long, note string"
    folder = tmp_path / "in"
    for k, rows in enumerate([[("a", 1, 1, "old")], [("a", 2, 2, "new"), ("b", 1, 2, "b")], [("a", 1, 3, "late"), ("a", 2, 4, "more")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{folder}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}")
    run = events.fenced(stream).writeStream.format("memory").queryName("fenced").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(r["note"] for r in spark.table("fenced").collect()) == ["b", "more", "new", "old"]


def test_duplicates_across_batches(spark, tmp_path):
    schema = "file_id string, seq int, start double, end double, text string"
    folder = tmp_path / "in"
    for row in [("f", 0, 0.0, 1.0, "x"), ("f", 1, 1.05, 2.0, "x"), ("f", 2, 2.05, 3.0, "x")]:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"file://{folder}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}")
    run = events.drop_near_duplicates(stream).writeStream.format("memory").queryName("kept").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(r["seq"] for r in spark.table("kept").collect()) == [0, 2]


def test_event_lines_and_upserts(spark, tmp_path):
    (tmp_path / "log").mkdir()
    lines = ['{"protocol": 1, "event": "job_started", "job_id": "a", "generation": "g"}', "broken", '{"protocol": 9, "event": "x"}',
             '{"protocol": 1, "event": "job_failed", "job_id": "a", "generation": "before"}', '{"protocol": 1, "event": "job_failed", "job_id": "a"}']
    (tmp_path / "log" / "1.jsonl").write_text("\n".join(lines) + "\n")
    stream = events.event_stream(spark, f"file://{tmp_path}/log", generation="g")
    updates = stream.where("valid").select(F.col("job_id").alias("key"), F.col("event").alias("status"), F.lit(1).alias("updated_at"))
    table = StateTable(spark, f"file://{tmp_path}/states", "key string, status string, updated_at int")
    table.upsert(updates, f"file://{tmp_path}/c").awaitTermination()
    assert [tuple(r) for r in table.read().collect()] == [("a", "job_started", 1)]
    latest = events.latest_progress(spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "job_id string, seq int, note string"))
    assert [tuple(r) for r in latest.collect()] == [("a", 2, "y")]


STATES = "key string, status string, error string, updated_at int"


def test_snapshots_hold_what_all_updates_hold(spark, tmp_path):
    rng, plain = random.Random(4), {}
    table = StateTable(spark, f"file://{tmp_path}", STATES)
    assert table.read().collect() == [] and table.compact() == -1
    schema = STATES + ", cleared array<string>"
    for number in range(9):
        rows = []
        for at in range(rng.randrange(1, 6)):
            key, cleared = rng.choice("abc"), rng.choice([None, [], ["error"]])
            status, error = rng.choice([None, "s%d" % number]), None if cleared else rng.choice([None, "e%d" % number])
            rows.append((key, status, error, at, cleared))
            own = plain.setdefault(key, [None, None, None])
            own[0], own[1], own[2] = status or own[0], None if cleared else error or own[1], at
        table.append(spark.createDataFrame(rows, schema), number)
        table.append(spark.createDataFrame(rows, schema), number)
        if number in (2, 6):
            assert table.compact() == number and table.tail() == 0
        assert {r[0]: list(r[1:]) for r in table.read().collect()} == plain
    assert table.tail() == 2
    # Reading costs the snapshot and the tail; the deltas that the last but one snapshot held are gone.
    files = [f for f in table.read().inputFiles()]
    assert {f.split("/")[-2] for f in files if "deltas" in f} == {"batch=7", "batch=8"}
    assert sorted(p.name for p in (tmp_path / "deltas").iterdir()) == [f"batch={n}" for n in range(3, 9)]


def test_a_compaction_that_ends_early_changes_nothing(spark, tmp_path, monkeypatch):
    table = StateTable(spark, f"file://{tmp_path}", STATES)
    for number in range(4):
        table.append(spark.createDataFrame([("a", f"s{number}", None, 1), (f"k{number}", "x", None, 1)], STATES), number)
        if number == 1:
            table.compact()
    before = sorted(map(tuple, table.read().collect()))
    for step in ("put", "locate"):
        with monkeypatch.context() as patch:
            patch.setattr(versioned, step, lambda *_: (_ for _ in ()).throw(OSError("ended")))
            with pytest.raises(OSError):
                table.compact()
        assert sorted(map(tuple, table.read().collect())) == before
    assert table.compact() == 3 and sorted(map(tuple, table.read().collect())) == before


def test_upserts_compact_and_may_be_run_again(spark, tmp_path):
    schema = "key string, status string, updated_at int"
    for n in range(7):
        spark.createDataFrame([(f"k{n % 3}", f"s{n}", n)], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        time.sleep(0.02)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    table = StateTable(spark, f"file://{tmp_path}/t", schema)
    table.upsert(stream, f"file://{tmp_path}/c", compact_after=3).awaitTermination()
    wanted = [("k0", "s6", 6), ("k1", "s4", 4), ("k2", "s5", 5)]
    assert sorted(map(tuple, table.read().collect())) == wanted and table.tail() < 3
    # From the beginning, as if the query's own checkpoint were lost.
    table.upsert(stream, f"file://{tmp_path}/c2", compact_after=3).awaitTermination()
    assert sorted(map(tuple, table.read().collect())) == wanted


def memory_query(frame, name, folder, **trigger):
    return frame.writeStream.format("memory").queryName(name).option("checkpointLocation", f"file://{folder}").trigger(**trigger).start()


def test_an_overdue_stage_fires_without_a_further_event(spark, tmp_path):
    timers.use_keyed_state(spark)
    rows = [("late", 1, 1, "stt", "started"), ("done", 1, 1, "stt", "started"), ("done", 1, 2, "stt", "ended"), ("new", 1, 1, "init", "started"),
            ("again", 1, 1, "stt", "started"), ("again", 2, 2, "stt", "started"), ("again", 1, 3, "stt", "ended"), ("again", 2, 4, "stt", "ended"),
            ("free", 1, 1, "translate", "started"), ("never", 1, 1, "stt", "ended")]
    spark.createDataFrame(rows, timers.EVENT).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(timers.EVENT).parquet(f"file://{tmp_path}/in")
    found = timers.stage_outcomes(stream, {"stt": 4.0, "init": 4.0})
    run = memory_query(found, "outcomes", tmp_path / "c", processingTime="1 second")
    try:
        said = lambda: sorted((r["job_id"], r["attempt_no"], r["outcome"], r["retry"]) for r in spark.table("outcomes").collect())
        ended = [("again", 2, "ended", None), ("done", 1, "ended", None)]
        over = [("late", 1, "stt_timeout", False), ("new", 1, "init_timeout", True)]
        until = time.time() + 90
        while len(said()) < 4 and time.time() < until:
            time.sleep(0.5)
        assert said() == sorted(ended + over)
        # An end after the time was up is no outcome, and only the attempt without a limit has state left.
        spark.createDataFrame([("late", 1, 9, "stt", "ended")], timers.EVENT).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        # With timers, batches without data never end, so "all available" is never reached.
        while sum(p["numInputRows"] for p in run.recentProgress) < len(rows) + 1 and time.time() < until:
            time.sleep(0.5)
        time.sleep(2)
        assert said() == sorted(ended + over)
    finally:
        run.stop()
    state = spark.read.format("statestore").option("path", f"file://{tmp_path}/c").option("stateVarName", "running").load()
    assert [r["key"]["job_id"] for r in state.select("key").collect()] == ["free"]


def test_breakers_gate_what_comes_after_and_answer_alike_again(spark, tmp_path):
    timers.use_keyed_state(spark)
    none = (None, None, None, None, None)
    events_ = [
        ("b", 1, "dispatch", "x", "translate", *none), ("b", 2, "result", "x", "translate", 503, None, None, None, None),
        ("b", 3, "dispatch", "y", "translate", *none), ("b", 4, "result", "y", "translate", 401, None, None, None, None),
        ("b", 5, "dispatch", "z", "translate", *none), ("b", 6, "dispatch", "z", "stt", *none),
        ("b", 7, "failure", "z", "stt", *none), ("b", 8, "failure", "z", "stt", *none), ("b", 9, "dispatch", "w", "stt", *none),
        ("b", 10, "failure", "w", "stt", *none), ("b", 11, "dispatch", "v", "stt", *none),
        ("b", 12, "result", "v", "extract", None, "No space left on device", None, None, None), ("b", 13, "dispatch", "v", "extract", *none),
        ("c", 1, "failure", None, "stt", None, None, None, True, None), ("c", 2, "dispatch", "x", "stt", *none),
        ("d", 1, "failure", None, "stt", *none), ("d", 2, "failure", "x", "stt", None, None, None, None, True), ("d", 3, "result", "x", "extract", None, None, 10, None, None),
    ]
    wanted = ["admit", "noted", "admit", "pause", "hold", "admit", "retry", "fail", "admit", "fail", "hold", "pause", "hold", "block", "hold", "restart", "fail", "pause"]
    answers = {(e[0], e[1]): a for e, a in zip(events_, wanted, strict=True)}
    for at in range(0, len(events_), 3):
        spark.createDataFrame(events_[at : at + 3], breaker.EVENT).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        time.sleep(0.02)
    stream = spark.readStream.schema(breaker.EVENT).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    said = lambda rows: {(r["batch"], r["seq"]): r["answer"] for r in rows}

    def write(seen):
        def one(frame, number):
            rows = said(frame.collect())
            seen.setdefault(number, rows)
            if number == 2 and "ended" not in seen:
                seen["ended"] = True
                raise RuntimeError("the driver ends within a batch")
            assert seen[number] == rows

        return one

    seen: dict = {}
    start = lambda: breaker.gated(stream).writeStream.foreachBatch(write(seen)).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    with pytest.raises(Exception, match="ended|ends"):
        start().awaitTermination()
    start().awaitTermination()
    seen.pop("ended")
    assert {k: v for rows in seen.values() for k, v in rows.items()} == answers
