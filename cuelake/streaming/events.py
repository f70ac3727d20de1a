"""Structured Streaming over worker events and segments.

Late results are told by token (generation and attempt), not by time, so no watermark may drop
them; the state kept is one row a key. It is kept for good: a processing-time timeout would drop it, but
with one a query of trigger ``availableNow`` never ends (``timers`` has its state go with the attempt).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cuelake import schemas

PROTOCOL = 1


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000, generation: str | None = None) -> DataFrame:
    """Events of JSON lines as they arrive; ``valid`` is false for lines to set aside, and for those of another generation than the one given."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    parsed = lines.select("value", F.from_json("value", schemas.EVENT).alias("e"))
    fits = (F.col("e.protocol") == PROTOCOL) & F.col("e.event").isNotNull()
    if generation is not None:
        fits &= F.col("e.generation") == generation
    valid = F.coalesce(fits, F.lit(False))
    return parsed.select("e.*", valid.alias("valid"), "value")


def fenced(events: DataFrame) -> DataFrame:
    """Events but those of an older attempt of their job than one already seen in the stream.

    Events have job_id, attempt_no (rising) and seq; all columns are passed through.
    """
    schema = events.schema

    def one_job(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest = state.get[0] if state.exists else -1
        rows = pd.concat(list(frames)).sort_values("seq")
        top = rows["attempt_no"].cummax().clip(lower=newest)
        state.update((int(max(newest, rows["attempt_no"].max())),))
        yield rows[rows["attempt_no"] >= top]

    return events.groupBy("job_id").applyInPandasWithState(one_job, schema, "newest long", "append", GroupStateTimeout.NoTimeout)


def drop_near_duplicates(segments: DataFrame, *, window_seconds: float = 0.1) -> DataFrame:
    """The duplicate filter over a stream of segments (file_id, seq, start, end, text) in order of seq."""

    def one_file(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text, end = state.get if state.exists else (None, 0.0)
        rows = pd.concat(list(frames)).sort_values("seq")
        keep = []
        for this, start, stop in zip(rows["text"].str.strip(), rows["start"], rows["end"], strict=True):
            kept = text is None or this != text or start > end + window_seconds
            if kept:
                text, end = this, stop
            keep.append(kept)
        if text is not None:
            state.update((text, float(end)))
        yield rows[keep]

    return segments.groupBy("file_id").applyInPandasWithState(
        one_file, segments.schema, "text string, end double", "append", GroupStateTimeout.NoTimeout
    )


def latest_progress(events: DataFrame, key: str = "job_id") -> DataFrame:
    """The newest event of each key (complete mode): progress is coalesced, whatever came in between."""
    columns = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*columns), "seq").alias("e")).select(key, "e.*")
