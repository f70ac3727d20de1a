"""Recordings count by their proof."""

import wave

from pyspark.sql import functions as F

from cuelake.functions import identity
from cuelake.operators import recordings


def sound(path, frames, rate=16000):
    with wave.open(str(path), "wb") as file:
        file.setnchannels(1), file.setframerate(rate), file.setsampwidth(2)
        file.writeframes(bytes(2 * frames))


def test_identity_is_that_of_canonical_json(spark):
    video = {"size": 12, "mtime_ns": 1_700_000_000_123_456_789, "sample_sha256": "ab"}
    row = spark.createDataFrame([(12, 1_700_000_000_123_456_789, "ab")], "size long, mtime_ns long, sample_sha256 string")
    found = row.select(recordings.audio_identity(F.col("size"), F.col("mtime_ns"), F.col("sample_sha256"))).first()[0]
    assert found == identity.identity({"video": video, "channels": 1, "rate": 16000, "format": "pcm_s16le", "version": 1})


def test_a_readable_recording_without_its_proof_does_not_count(spark, tmp_path):
    for name, frames in (("done", 100), ("grown", 100), ("unproven", 100), ("bad", 0), ("other", 100), ("gone", 100)):
        sound(tmp_path / f"{name}.wav", frames)
    sound(tmp_path / "rate.wav", 100, 8000)
    schema = "job_id string, identity string, path string"
    made = [(n, "i1", f"file:{tmp_path}/{n}.wav") for n in ("done", "grown", "bad", "other", "gone", "rate")]
    proofs = f"file://{tmp_path}/proofs"
    recordings.prove(spark.createDataFrame(made, schema), proofs)
    held = spark.read.schema(recordings.PROOF).parquet(proofs)
    assert {r["job_id"] for r in held.collect()} == {"done", "grown", "other", "gone"}
    sound(tmp_path / "grown.wav", 101)
    (tmp_path / "gone.wav").unlink()
    now = [(n, "i2" if n == "other" else "i1", f"file:{tmp_path}/{n}.wav") for n in ("done", "grown", "unproven", "bad", "other", "gone")]
    found = recordings.proven(spark.createDataFrame([*now, now[0]], schema), held)
    assert sorted((r["job_id"], r["proven"]) for r in found.collect()) == [
        ("bad", False), ("done", True), ("done", True), ("gone", False), ("grown", False), ("other", False), ("unproven", False)]
    # After a second extraction of the grown one.
    recordings.prove(spark.createDataFrame([now[1]], schema), proofs)
    held = spark.read.schema(recordings.PROOF).parquet(proofs)
    assert recordings.proven(spark.createDataFrame([now[1]], schema), held).first()["proven"]
