"""Checks of translated cues against their sources, and of output names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions.text import LINE_BREAK, is_blank, normalized_text, text_lines


def _placed(cues: DataFrame) -> DataFrame:
    return cues.withColumn("position", F.row_number().over(Window.partitionBy("file_id").orderBy("cue_index")))


def zip_translations(cues: DataFrame, translations: DataFrame) -> DataFrame:
    """Cues with the translation at their position (file_id, position from 1, translation).

    Files whose counts differ, or with a blank translation, have error set on every row instead.
    """
    joined = _placed(cues).join(translations, ["file_id", "position"], "full_outer")
    fits = F.col("cue_index").isNotNull() & F.col("translation").isNotNull()
    per_file = Window.partitionBy("file_id")
    error = F.when(~F.min(fits).over(per_file), "count").when(
        F.max(F.coalesce(is_blank(F.col("translation")), F.lit(False))).over(per_file), "blank"
    )
    return joined.withColumn("error", error)


def validate_translation(sources: DataFrame, outputs: DataFrame, language: str, mode: str, *, legacy: bool = False) -> DataFrame:
    """file_id and valid: same count, numbers and times; a bilingual cue is its source line over one more.

    ``legacy`` joins the source's lines without spaces whatever the language.
    """
    one = _placed(sources).select("file_id", "position", F.struct("cue_index", "start_ms", "end_ms").alias("at"), F.col("text").alias("source"))
    other = _placed(outputs).select("file_id", "position", F.struct("cue_index", "start_ms", "end_ms").alias("out_at"), F.col("text").alias("output"))
    both = one.join(other, ["file_id", "position"], "full_outer")
    same = F.coalesce(F.col("at") == F.col("out_at"), F.lit(False))
    if mode == "bilingual":
        lines = F.split("output", LINE_BREAK)
        wanted = F.array_join(text_lines(F.col("source")), "") if legacy else normalized_text(F.col("source"), F.lit(language))
        good = (F.size(lines) == 2) & (F.get(lines, F.lit(0)) == wanted) & ~is_blank(F.get(lines, F.lit(1)))
    else:
        good = ~is_blank(F.col("output"))
    return both.select("file_id", (same & F.coalesce(good, F.lit(False))).alias("ok")).groupBy("file_id").agg(F.bool_and("ok").alias("valid"))


def is_bilingual(cues: DataFrame) -> DataFrame:
    """file_id and whether every cue has two lines or more."""
    return cues.groupBy("file_id").agg(F.bool_and(F.size(F.split("text", LINE_BREAK)) >= 2).alias("bilingual"))


def output_collisions(targets: DataFrame) -> DataFrame:
    """Output names (in lower case) that several inputs (input, target) map to, and how many."""
    named = targets.groupBy(F.lower("target").alias("target")).agg(F.count_distinct("input").alias("inputs"))
    return named.where("inputs > 1")
