"""Tables replaced whole: versions in folders of their own, and a small pointer to the one that holds.

Spark's ``overwrite`` deletes first, so a reader or a crash in between finds nothing. Here a new version is written beside the old one
and a pointer file is moved over the old pointer, which is one step on file systems that replace by a rename. A version that
was never pointed to is only a folder, removed by the next replacement. One program writes a table at a time.

With a ``base``, a replacement is refused if another version came in between: what it was made from no longer holds.
"""

from __future__ import annotations

import json
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from cuelake.sources.stores import is_file, locate
from cuelake.sources.subtitle_sink import put

POINTER = "_current.json"


def pointer(folder: str) -> dict:
    """What the pointer says: version (null: no version yet), and what was noted with it."""
    store, root = locate(folder)
    if not is_file(store, f"{root}/{POINTER}"):
        return {"version": None}
    with store.open_input_stream(f"{root}/{POINTER}") as file:
        return json.loads(file.read())


def replace(table: DataFrame, folder: str, form: str = "parquet", *, note: dict | None = None, base: str | None = None, checked: bool = False) -> str:
    """Writes ``table`` as the version that holds from now on; its name. The two last versions stay, for readers under way."""
    version = uuid.uuid4().hex
    table.write.format(form).save(f"{folder}/{version}")
    old = pointer(folder)["version"]
    if checked and old != base:
        raise RuntimeError(f"version {old} came in place of {base}")
    store, root = locate(folder)
    put(store, f"{root}/{POINTER}", json.dumps({**(note or {}), "version": version, "form": form}).encode())
    for entry in store.get_file_info(fs.FileSelector(root)):
        if entry.type == fs.FileType.Directory and entry.base_name not in (version, old):
            store.delete_dir(entry.path)
    return version


def read(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """The table as it holds now; empty if there is none yet."""
    now = pointer(folder)
    if now["version"] is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).format(now["form"]).load(f"{folder}/{now['version']}")
