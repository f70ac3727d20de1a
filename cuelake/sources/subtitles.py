"""Reading subtitle files, and the JSON records kept about them.

Files come as ``binaryFile`` rows. Decoding needs Python's codecs, so it is one Arrow-batched
function; parsing is built-in expressions. A file is valid as a whole or not at all: one bad block
rejects it, and ``error`` says why.
"""

from __future__ import annotations

import codecs
import io
import wave

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake import schemas
from cuelake.functions.text import LINE_BREAK, SPACE, strip
from cuelake.functions.timecodes import TIME, to_milliseconds

VIDEO_SUFFIXES = ("mp4", "mkv", "mov", "avi", "wmv", "m4v", "webm", "ts")
ENCODINGS = ("auto", "utf-8", "utf-16", "utf-16-le", "utf-16-be", "gb18030", "big5")
#: The encodings an undeclared legacy file is tried in.
LEGACY = ("gb18030", "big5")


def scan_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """path, length and modificationTime of the videos below a folder. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    suffix = F.lower(F.element_at(F.split("path", r"\."), -1))
    return files.where(suffix.isin(*VIDEO_SUFFIXES)).select("path", "length", "modificationTime")


def read_files(spark: SparkSession, path: str, pattern: str = "*.srt") -> DataFrame:
    """path and content of subtitle files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return files.load(path).select("path", "content")


def decode_bytes(raw: bytes, encoding: str = "auto") -> tuple[str | None, str | None]:
    """Text, or else the kind of error: unsupported, undecodable, utf32, unknown, ambiguous or nul."""
    if encoding not in ENCODINGS:
        return None, "unsupported"
    known = encoding
    if encoding == "auto":
        if raw.startswith((codecs.BOM_UTF32_LE, codecs.BOM_UTF32_BE)):
            return None, "utf32"
        known = "utf-16" if raw.startswith((codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)) else "utf-8"
    try:
        text = raw.decode("utf-8-sig" if known == "utf-8" else known)
        if known != "utf-8":
            text = text.removeprefix("\ufeff")
    except UnicodeError:
        if encoding != "auto" or known != "utf-8":
            return None, "undecodable"
        readings = set()
        for name in LEGACY:
            try:
                readings.add(raw.decode(name))
            except UnicodeError:
                continue
        readings = {t for t in readings if "\0" not in t}
        if len(readings) != 1:
            return None, "ambiguous" if readings else "unknown"
        (text,) = readings
    if "\0" in text:
        return None, "nul"
    return text.replace("\r\n", "\n").replace("\r", "\n").strip(), None


def decode(content: Column, encoding: str = "auto") -> Column:
    """struct<text, error> of the bytes."""

    @F.pandas_udf("text string, error string")
    def decoded(raw: pd.Series) -> pd.DataFrame:
        rows = [decode_bytes(bytes(x or b""), encoding) for x in raw]
        return pd.DataFrame(rows, columns=["text", "error"])

    return decoded(content)


def blocks(texts: DataFrame, file: str = "file_id", text: str = "text") -> DataFrame:
    """file_id, position and the checked parts of every block of every text, with the error of each (null: fine)."""
    cut = texts.select(F.col(file).alias("file_id"), F.posexplode(F.split(F.col(text), r"\n[ \t]*\n")).alias("position", "block"))
    lines = cut.select("file_id", "position", F.split(strip(F.col("block")), LINE_BREAK).alias("lines"))
    head = strip(F.get("lines", F.lit(0)))
    times = strip(F.get("lines", F.lit(1)))
    body = F.slice("lines", 3, F.greatest(F.size("lines") - 2, F.lit(0)))
    header = rf"^({TIME})[{SPACE}]*-->[{SPACE}]*({TIME})\z"
    parsed = lines.select(
        "file_id",
        "position",
        F.size("lines").alias("n_lines"),
        F.when(head.rlike(r"^[0-9]{1,9}\z"), head.cast("int")).alias("cue_index"),
        to_milliseconds(F.regexp_extract(times, header, 1)).alias("start_ms"),
        to_milliseconds(F.regexp_extract(times, header, 2)).alias("end_ms"),
        strip(F.array_join(body, "\n")).alias("text"),
        F.exists(body, lambda x: x.contains("-->")).alias("has_arrow"),
    )
    error = (
        F.when((F.col("n_lines") < 3) | F.col("cue_index").isNull(), "malformed")
        .when(F.col("start_ms").isNull() | F.col("end_ms").isNull(), "timestamp")
        .when(F.col("end_ms") <= F.col("start_ms"), "order")
        .when((F.col("text") == "") | F.col("has_arrow"), "text")
    )
    return parsed.select("file_id", "position", "cue_index", "start_ms", "end_ms", "text", error.alias("error"))


def parse(texts: DataFrame, file: str = "file_id", text: str = "text") -> DataFrame:
    """Cues (file_id, cue_index, start_ms, end_ms, text) of the valid texts, and one row with an error for each other.

    The rows of a text are made together and stay in one task until its verdict, so the only
    shuffle is by file.
    """
    checked = blocks(texts, file, text)
    # A file's blocks as one array: it holds what the text held.
    row = F.struct("position", "cue_index", "start_ms", "end_ms", "text", "error")
    files = checked.groupBy("file_id").agg(F.sort_array(F.collect_list(row)).alias("cues"))
    indexes = F.transform("cues", lambda c: c["cue_index"])
    falls = F.exists(F.sequence(F.lit(0), F.size("cues") - 1), lambda k: F.get(indexes, k) <= F.coalesce(F.get(indexes, k - 1), F.lit(0)))
    first_error = F.get(F.filter(F.transform("cues", lambda c: c["error"]), lambda e: e.isNotNull()), F.lit(0))
    judged = files.select("file_id", "cues", F.coalesce(first_error, F.when(falls, "index")).alias("file_error"))
    good = judged.where("file_error is null").select("file_id", F.inline("cues"))
    good = good.select("file_id", "cue_index", "start_ms", "end_ms", "text", F.lit(None).cast("string").alias("error"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("cue_index", "int"), ("start_ms", "bigint"), ("end_ms", "bigint"), ("text", "string"))]
    bad = judged.where("file_error is not null").select("file_id", *none, F.col("file_error").alias("error"))
    return good.unionByName(bad)


def read_cues(spark: SparkSession, path: str, *, encoding: str = "auto") -> DataFrame:
    """Cues of all subtitle files below a path, with one error row for each file that isn't valid.

    Files of no bytes at all are passed over by Spark's file listing and have no row; files of blanks have.
    """
    files = read_files(spark, path).select(F.col("path").alias("file_id"), decode(F.col("content"), encoding).alias("d"))
    files = files.select("file_id", F.col("d.text").alias("text"), F.col("d.error").alias("error"))
    empty = F.when(F.col("error").isNull() & (F.col("text") == ""), "empty").otherwise(F.col("error"))
    files = files.withColumn("error", empty)
    cues = parse(files.where("error is null"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("cue_index", "int"), ("start_ms", "bigint"), ("end_ms", "bigint"), ("text", "string"))]
    return cues.unionByName(files.where("error is not null").select("file_id", *none, "error"))


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """Task states as rows, from one JSON object a line; lines that aren't such objects are left out."""
    rows = spark.read.schema(schemas.STATE).option("mode", "PERMISSIVE").json(path)
    return rows.where("key is not null")


def read_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """Checkpoints of JSON lines with the input each belongs to; lines that aren't such objects are left out."""
    rows = spark.read.schema(f"input string, {schemas.CHECKPOINT}").option("mode", "PERMISSIVE").json(path)
    return rows.where("version is not null and source_sha256 is not null and translations is not null")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Worker events of JSON lines; valid says whether the line was an object with an event."""
    lines = spark.read.text(path)
    parsed = lines.select("value", F.from_json("value", schemas.EVENT).alias("e"))
    return parsed.select("e.*", F.coalesce(F.col("e.event").isNotNull(), F.lit(False)).alias("valid"), "value")


def wav_error(content: Column) -> Column:
    """Null for a mono recording of 16 kHz and two bytes a sample with frames, else what is wrong."""

    def check(raw: bytes) -> str | None:
        try:
            with wave.open(io.BytesIO(raw)) as sound:
                if (sound.getnchannels(), sound.getframerate(), sound.getsampwidth()) != (1, 16000, 2):
                    return "format"
                frames = sound.getnframes()
                if frames <= 0:
                    return "empty"
                sound.setpos(frames - 1)
                return None if len(sound.readframes(1)) == 2 else "truncated"
        except (wave.Error, EOFError):
            return "unreadable"

    @F.pandas_udf("string")
    def checked(raw: pd.Series) -> pd.Series:
        return pd.Series([check(bytes(x or b"")) for x in raw], dtype=object)

    return checked(content)
