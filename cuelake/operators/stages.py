"""Stage results as state transitions, for all jobs of a batch at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Parts of error messages that tell a broken worker, and a full disk.
FATAL = ("cuda", "out of memory", "cublas", "cudnn", "device-side")
DISK_FULL = ("no space left on device", "not enough space on the disk", "disk full")
#: Answers of a translation service after which asking on is of no use.
BLOCKING_STATUS = (400, 401, 403, 404, 429)
#: Seconds in which a worker has loaded its model.
START_SECONDS = 1200.0
LEAST_FREE_BYTES = 512 * 1024 * 1024


def mentions(message: Column, parts: tuple[str, ...]) -> Column:
    lowered = F.lower(F.coalesce(message, F.lit("")))
    return F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(lowered, p))


def is_fatal(message: Column) -> Column:
    return mentions(message, FATAL)


def advance(results: DataFrame) -> DataFrame:
    """``results`` (stage, success, error, segments) with the phase that follows.

    A finished extraction has its audio ready, a recognition a source (none, if it found no
    segments), a translation is complete. A full disk sends an extraction back; other failures fail.
    """
    c = F.col
    done = (
        F.when(c("stage") == "extract", "audio_ready")
        .when(c("stage") == "stt", F.when(c("segments") > 0, "source_ready").otherwise("no_text"))
        .when(c("stage") == "translate", "complete")
    )
    failed = F.when((c("stage") == "extract") & mentions(c("error"), DISK_FULL), "pending").otherwise("failed")
    return results.withColumn("phase", F.when(c("success"), done).otherwise(failed))


def overdue(running: DataFrame, local_seconds: float | None = None, start_seconds: float = START_SECONDS) -> DataFrame:
    """``running`` (stage: init or stt, ready, elapsed seconds) with failure: init_timeout or stt_timeout, else null.

    A worker that isn't ready in time has failed to start and may be started again; a recognition over its
    limit (None: no limit) isn't, and nothing of it is committed.
    """
    c = F.col
    late_start = ~c("ready") & (c("elapsed") > start_seconds)
    late = (c("stage") == "stt") & c("ready") & (c("elapsed") > F.lit(local_seconds).cast("double"))
    failure = F.when(late_start, "init_timeout").when(late, "stt_timeout")
    return running.withColumn("failure", failure).withColumn("retry", F.when(failure.isNotNull(), failure == "init_timeout"))


def pauses(results: DataFrame, batch: str = "batch") -> DataFrame:
    """By batch, which stages its results (stage, status, error, free_bytes) call to pause."""
    c = F.col
    low = F.coalesce(c("free_bytes") < LEAST_FREE_BYTES, F.lit(False)) | mentions(c("error"), DISK_FULL)
    return results.groupBy(batch).agg(
        F.bool_or((c("stage") == "extract") & low).alias("extract_paused"),
        F.bool_or((c("stage") == "translate") & F.coalesce(c("status").isin(*BLOCKING_STATUS), F.lit(False))).alias("translate_paused"),
    )
