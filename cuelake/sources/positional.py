"""Facts about big files, read from where they stand in them.

Spark's ``binaryFile`` reader loads a file whole, which takes a task's memory for a recording and can't take one of 2 GB. Here a row
of the input is an address, and tasks open it through pyarrow's file systems, seek, and read only what a fact needs: 64 KiB at
either end for an identity, a header and the last frame for a recording, blocks of 4 MiB in turn for a whole hash. Memory is that of a
block, whatever the file's size.

A file that is missing or can't be read gives a row with ``error`` in place of facts; one file's trouble is never another's. Null
addresses are errors of their own, repeated addresses are rows of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import wave
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.shared import numbered
from cuelake.sources.stores import locate
from cuelake.sources.subtitles import VIDEO_SUFFIXES

SAMPLE = 64 * 1024
BLOCK = 4 << 20

IDENTITY = pa.schema([("size", pa.int64()), ("mtime_ns", pa.int64()), ("sample_sha256", pa.string())])
WHOLE = pa.schema([("size", pa.int64()), ("sha256", pa.string())])
SOUND = pa.schema([("frames", pa.int64()), ("sound_error", pa.string())])


def ordered_inputs(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = VIDEO_SUFFIXES) -> DataFrame:
    """number (from 0), path, length and modificationTime of the files below a folder with such suffixes, in order of their paths.

    Contents aren't read. Numbers come from ranges of paths, so no task sorts all of them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    suffix = F.lower(F.element_at(F.split("path", r"\."), -1))
    found = files.where(suffix.isin(*suffixes)).select("path", "length", "modificationTime")
    return numbered(found, [F.col("path")], "number", "ordered-inputs").select("number", "path", "length", "modificationTime")


def sampled(store: fs.FileSystem, path: str, sample: int) -> tuple:
    """Size, time of the last change and hash of the size and both ends. A file of ``sample`` bytes or fewer has no second end."""
    info = store.get_file_info(path)
    if info.type != fs.FileType.File:
        raise FileNotFoundError(path)
    digest = hashlib.sha256(str(info.size).encode())
    with store.open_input_file(path) as file:
        digest.update(file.read(sample))
        if info.size > sample:
            file.seek(info.size - sample)
            digest.update(file.read(sample))
    return info.size, info.mtime_ns, digest.hexdigest()


def hashed(store: fs.FileSystem, path: str) -> tuple:
    digest, size = hashlib.sha256(), 0
    with store.open_input_stream(path) as file:
        while block := file.read(BLOCK):
            digest.update(block)
            size += len(block)
    return size, digest.hexdigest()


def sound(store: fs.FileSystem, path: str) -> tuple:
    """Frames, and null for a mono recording of 16 kHz and two bytes a sample with frames down to its end, else what is wrong."""
    with store.open_input_file(path) as file:
        try:
            with wave.open(file) as recording:
                frames = recording.getnframes()
                if (recording.getnchannels(), recording.getframerate(), recording.getsampwidth()) != (1, 16000, 2):
                    return frames, "format"
                if frames <= 0:
                    return frames, "empty"
                recording.setpos(frames - 1)
                return frames, None if len(recording.readframes(1)) == 2 else "truncated"
        except (wave.Error, EOFError):
            return None, "unreadable"


def facts(paths: DataFrame, read: Callable[[fs.FileSystem, str], tuple], schema: pa.Schema, path: str = "path") -> DataFrame:
    """``paths`` with the columns of ``schema`` as ``read`` finds them, and error.

    Addresses are dealt out by their hash, since a file costs a request or more however short its row is.
    """
    spread = paths.withColumn("__path", F.col(path).cast("string")).repartition("__path")
    rows = paths.schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for address in batch.column("__path").to_pylist():
                try:
                    if address is None:
                        raise ValueError("no address")
                    found.append((*read(*locate(address)), None))
                except (OSError, ValueError) as e:
                    found.append((*[None] * len(schema), type(e).__name__))
            columns = zip(*found, strict=True) if found else [[] for _ in range(len(schema) + 1)]
            types = [*schema.types, pa.string()]
            arrays = [batch.column(c) for c in rows] + [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*rows, *schema.names, "error"])

    names = {pa.int64(): "long", pa.string(): "string"}
    added = [F.lit(None).cast(names[f.type]).alias(f.name) for f in schema] + [F.lit(None).cast("string").alias("error")]
    return spread.mapInArrow(run, paths.select("*", *added).schema)


def file_identities(paths: DataFrame, *, sample: int = SAMPLE, path: str = "path") -> DataFrame:
    """``paths`` with size, mtime_ns and sample_sha256: what tells that an input is still the one seen before."""
    return facts(paths, lambda store, name: sampled(store, name, sample), IDENTITY, path)


def file_hashes(paths: DataFrame, *, path: str = "path") -> DataFrame:
    """``paths`` with size and sha256 of whole files."""
    return facts(paths, hashed, WHOLE, path)


def sound_checks(paths: DataFrame, *, path: str = "path") -> DataFrame:
    """``paths`` with frames and sound_error (null: fine) of recordings; of each, the header and the last frame are read."""
    return facts(paths, sound, SOUND, path)


def unchanged(before: DataFrame, *, sample: int = SAMPLE) -> DataFrame:
    """Inputs with their identity as it was (path, size, mtime_ns, sample_sha256) and unchanged: the file there now has the same."""
    fields = ["size", "mtime_ns", "sample_sha256"]
    now = file_identities(before.select("path", *(F.col(c).alias(f"__{c}") for c in fields)), sample=sample)
    same = F.col("error").isNull()
    for c in fields:
        same &= F.coalesce(F.col(c) == F.col(f"__{c}"), F.lit(False))
    return now.select("path", *(F.col(f"__{c}").alias(c) for c in fields), same.alias("unchanged"))
