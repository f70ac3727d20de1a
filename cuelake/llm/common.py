"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.shared import materialise

__all__ = ["LOWER", "WORDS", "bind", "held_out", "materialise", "slices", "table", "texts_as_bytes"]

#: bytes.translate tables. LOWER lowers A-Z only. WORDS also turns every ASCII character that is
#: neither a letter nor a digit into a space, so that split() yields the words
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the lower-cased text (UTF-8 bytes from 0x80 on stay).
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """The evaluation fold: crc32 of the id as text (null: never held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, even where body names it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def texts_as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 of every text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most_bytes`` of text, so that very long texts don't pile up."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, int(batch.num_rows * most_bytes / max(1, batch.column(text).nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
