"""Counts and durations of a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ("complete", "no_text", "failed")


def phase_counts(jobs: DataFrame, *keys: str) -> DataFrame:
    """Totals by phase in one pass, over all jobs or by key."""
    phase = F.col("phase")
    return jobs.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.count_if(phase.isin(*TERMINAL)).alias("completed"),
        F.count_if(phase == "failed").alias("failed"),
        F.count_if(phase == "complete").alias("finished"),
        F.count_if(phase == "no_text").alias("no_text"),
        F.count_if(phase == "source_ready").alias("pending_translation"),
        F.count_if(phase.isin("audio_ready", "extracting")).alias("audio_ahead"),
    )


def exit_code(counts: DataFrame, stopped: bool = False) -> DataFrame:
    """Counts with unfinished and the exit code: 130 if stopped, 1 with failures or unfinished jobs, else 0."""
    unfinished = F.col("total") - F.col("completed")
    code = F.when(F.lit(stopped), 130).when((F.col("failed") > 0) | (unfinished > 0), 1).otherwise(0)
    return counts.withColumn("unfinished", unfinished).withColumn("exit_code", code)


def batch_metrics(jobs: DataFrame, batch: str, *, stopped: bool = False) -> DataFrame:
    """What is written at a batch's end, a row a batch of jobs (phase, recognized, started and ended seconds)."""
    counts = exit_code(phase_counts(jobs, batch), stopped).select(batch, "total", "completed", "failed", "unfinished", "exit_code")
    more = jobs.groupBy(batch).agg(F.count_if("recognized").alias("recognized"), (F.max("ended") - F.min("started")).alias("elapsed_seconds"))
    return counts.join(more, batch).withColumn("stopped", F.lit(stopped))


def stage_durations(stages: DataFrame) -> DataFrame:
    """By stage: runs, successes, and seconds in all and at most."""
    return stages.groupBy("stage").agg(
        F.count("*").alias("runs"),
        F.count_if("success").alias("succeeded"),
        F.sum("seconds").alias("seconds"),
        F.max("seconds").alias("longest"),
    )


def dispatch_gaps(jobs: DataFrame, lane: str, start: Column, end: Column, order: list[str]) -> DataFrame:
    """Jobs with gap: the time from the end of the lane's previous job to this one's start, not below 0 (first: null)."""
    before = F.lag(end).over(Window.partitionBy(lane).orderBy(*order))
    return jobs.withColumn("gap", F.when(before.isNotNull(), F.greatest(F.lit(0.0), start - before)))


def percent_done(done: Column, total: Column) -> Column:
    """Whole percents done; null of a total of 0."""
    return F.floor(F.try_divide(done * 100, total)).cast("int")
