"""Rendering subtitles and writing records. ``subtitle_sink`` writes the files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.functions.text import normalized_text, strip
from cuelake.functions.timecodes import from_milliseconds, seconds_to_milliseconds
from cuelake.sources import versioned


def numbered_cues(segments: DataFrame) -> DataFrame:
    """Segments (file_id, seq, start, end, text) without blank ones, as cues numbered from 1 within each file."""
    from pyspark.sql import Window

    kept = segments.withColumn("text", strip(F.col("text"))).where("text <> ''")
    number = F.row_number().over(Window.partitionBy("file_id").orderBy("seq"))
    return kept.select(
        "file_id",
        number.alias("cue_index"),
        seconds_to_milliseconds(F.col("start")).alias("start_ms"),
        seconds_to_milliseconds(F.col("end")).alias("end_ms"),
        "text",
    )


def block_text(index: Column, start_ms: Column, end_ms: Column, body: Column) -> Column:
    times = F.concat(from_milliseconds(start_ms), F.lit(" --> "), from_milliseconds(end_ms))
    return F.concat(index.cast("string"), F.lit("\n"), times, F.lit("\n"), body, F.lit("\n\n"))


def render(cues: DataFrame) -> DataFrame:
    """file_id and the whole subtitle text of every file of cues."""
    block = block_text(F.col("cue_index"), F.col("start_ms"), F.col("end_ms"), F.col("text"))
    ordered = F.sort_array(F.collect_list(F.struct("cue_index", block.alias("block"))))
    return cues.groupBy("file_id").agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "").alias("srt"))


def translated_body(source: Column, translation: Column, source_language: Column, target_language: Column, mode: str) -> Column:
    """The cue's text in an output: source over translation, or the translation alone."""
    target = normalized_text(translation, target_language)
    if mode == "translated":
        return target
    if mode != "bilingual":
        raise ValueError(f"unknown output mode: {mode}")
    return F.concat(normalized_text(source, source_language), F.lit("\n"), target)


def write_files(rendered: DataFrame, folder: str) -> None:
    """The rendered texts as Parquet rows (file_id, srt), committed by Spark's own protocol: all or none appear."""
    rendered.write.mode("errorifexists").parquet(folder)


def write_checkpoints(checkpoints: DataFrame, folder: str) -> None:
    """Checkpoints (schemas.CHECKPOINT and input) as JSON lines in a new folder, committed by Spark: all or none appear."""
    checkpoints.write.mode("errorifexists").json(folder)


def write_metrics(metrics: DataFrame, folder: str) -> None:
    """A batch's metrics as JSON lines in place of those before, at one blow (``versioned``)."""
    versioned.replace(metrics, folder, "json")


def append_log(events: DataFrame, folder: str) -> None:
    """Events as JSON lines, appended."""
    events.write.mode("append").json(folder)
