"""Proof that a recording was finished.

A recording that can be read may still be what a broken extraction left behind. So an extraction that has succeeded sets down a
proof: for which input, in which state, and how large the recording was. A recording counts if its proof names the input as it is
now, the file has the proof's size, and its header and last frame can be read; files are read by position, never whole.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.sources import positional

# What recordings are, as identities name it.
FORM = {"channels": 1, "format": "pcm_s16le", "rate": 16000, "version": 1}
PROOF = "job_id string, identity string, size long"


def audio_identity(size: Column, mtime_ns: Column, sample_sha256: Column) -> Column:
    """``functions.identity.identity`` of the recording of a video with this identity."""
    video = F.concat(
        F.lit('{"mtime_ns":'), mtime_ns.cast("string"), F.lit(',"sample_sha256":"'), sample_sha256, F.lit('","size":'), size.cast("string"), F.lit("}")
    )
    form = json.dumps(FORM, sort_keys=True, separators=(",", ":"))
    return F.sha2(F.concat(F.lit(form[:-1] + ',"video":'), video, F.lit("}")), 256)


def prove(recordings: DataFrame, folder: str) -> None:
    """Appends proofs of the finished recordings (job_id, identity, path) whose files are sound; Spark commits all or none.

    To be called when the extractions have ended well. Recordings that aren't sound get no proof.
    """
    found = positional.sound_checks(positional.file_identities(recordings).drop("error"))
    sound = found.where(F.col("error").isNull() & F.col("sound_error").isNull())
    sound.select("job_id", "identity", "size").write.mode("append").parquet(folder)


def proven(recordings: DataFrame, proofs: DataFrame) -> DataFrame:
    """Recordings (job_id, identity, path) with proven. Any of a job's proofs will do; files are read for jobs with a fitting proof only."""
    held = proofs.select("job_id", "identity", F.col("size").alias("__size")).distinct()
    held = held.groupBy("job_id", "identity").agg(F.collect_set("__size").alias("__sizes"))
    fitting = positional.sound_checks(positional.file_identities(recordings.join(held, ["job_id", "identity"])).drop("error"))
    good = fitting.where(F.col("error").isNull() & F.col("sound_error").isNull() & F.array_contains("__sizes", F.col("size")))
    good = good.select("job_id", "identity", "path").distinct().withColumn("__good", F.lit(True))
    return recordings.join(good, ["job_id", "identity", "path"], "left").select(*recordings.columns, F.coalesce("__good", F.lit(False)).alias("proven"))
