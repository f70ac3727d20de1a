"""Task states kept as one JSON object of many keys, read as VARIANT.

Such a file is an object whose keys are inputs and whose values are open-ended objects. It is parsed once as a VARIANT and taken apart
by key; the known fields are then read out of each value, with their nested records, and what isn't known stays in ``more``. No schema
is imposed on the file, so a field of another type than expected is null in its column, or its JSON where a text is expected, and still
there as it was in ``more``.

Files that are missing, broken or no object give no rows; a key whose value is no object gives a row without fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of the fields that states hold.
_RECORD = "struct<path: string, translation_identity: string, output_identity: string, sha256: string>"
FIELDS = {
    "status": "string",
    "stage": "string",
    "updated_at": "string",
    "error": "string",
    "video_identity": "struct<size: bigint, mtime_ns: bigint, sample_sha256: string, source_sha256: string>",
    "stt_identity": "string",
    "source_sha256": "string",
    "translation_identity": "string",
    "output_identity": "string",
    "output": "string",
    "work_dir": "string",
    "outputs": f"map<string, {_RECORD}>",
    "source_pending": "struct<sha256: string, stt_identity: string>",
    "source_attempt": "struct<path: string, stt_identity: string, attempt: string>",
    "output_pending": _RECORD,
    "translation_attempt": "string",
    "translation_pending": "struct<path: string, translation_identity: string, output_identity: string>",
    "audio": "struct<identity: string, path: string, size: bigint>",
    "audio_attempt": "string",
}


def keyed_states(texts: DataFrame, text: str = "value", fields: dict[str, str] | None = None) -> DataFrame:
    """The columns of ``texts`` but the text itself, with key, the fields, and more (VARIANT, the whole value) for each key of each text."""
    fields = FIELDS if fields is None else fields
    kept = [c for c in texts.columns if c != text]
    parsed = texts.select(*kept, F.try_parse_json(text).alias("__object"))
    whole = parsed.where(F.schema_of_variant("__object").startswith("OBJECT"))
    apart = whole.lateralJoin(whole.sparkSession.tvf.variant_explode(F.col("__object").outer()))

    def field(name: str, kind: str) -> Column:
        return F.try_variant_get("value", f"$.{name}", kind).alias(name)

    return apart.select(*kept, "key", *(field(n, k) for n, k in fields.items()), F.col("value").alias("more"))


def read_keyed_states(spark: SparkSession, path: str, fields: dict[str, str] | None = None) -> DataFrame:
    """key, the fields and more of the state files at ``path``. A file is read whole, as one object can't be read in parts."""
    return keyed_states(spark.read.text(path, wholetext=True), "value", fields)
