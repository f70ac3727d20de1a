"""Timestamps of cues: text to milliseconds and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TIME = r"\d{2,}:[0-5]\d:[0-5]\d[,.]\d{3}"


def to_milliseconds(value: Column) -> Column:
    """``HH:MM:SS,mmm`` (or a dot) as a bigint; null if it isn't one."""
    part = lambda k: F.regexp_extract(value, r"^(\d{2,}):(\d\d):(\d\d)[,.](\d{3})\z", k).cast("bigint")
    found = ((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + part(4)
    return F.when(value.rlike(rf"^{TIME}\z"), found)


def from_milliseconds(ms: Column) -> Column:
    """``HH:MM:SS,mmm``; hours grow beyond two digits."""
    s = F.floor(ms / 1000)
    hours, rest = F.floor(s / 3600), s % 3600
    return F.format_string("%02d:%02d:%02d,%03d", hours, F.floor(rest / 60), rest % 60, ms % 1000)


def seconds_to_milliseconds(seconds: Column) -> Column:
    """Rounded half to even, not below zero."""
    return F.greatest(F.lit(0), F.rint(seconds * 1000.0).cast("bigint"))


def format_timestamp(seconds: Column) -> Column:
    return from_milliseconds(seconds_to_milliseconds(seconds))
