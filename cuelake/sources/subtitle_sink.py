"""Subtitle files written as one transaction.

``df.write.format("subtitle_files")`` takes rows (file_id, srt). Its tasks put every file beside its place, under
``.staged/<run>``, with a row in a list of theirs that says what is to happen: where the file goes, its hash, the hash of the file that
is there now, and the name under which that one will be kept. The write's commit sets down one small announcement naming those
lists; an abort removes what was staged. Nothing has moved yet: up to here all readers see the old files.

``publish`` makes announced runs true, in tasks, a file at a time: copy the old file to its announced name, move the new one over its
place. Either step is known by the hashes it leaves, so that a run that ended anywhere, in a task or with the driver, is
simply published again, and no backup loses its record, since the name was set down before anything moved. Readers see the old
file or the new one, never neither. Done runs have their records in ``.records`` as Parquet and lose their announcement last.

A file that changed since it was staged is neither replaced nor kept: its record says ``changed``. Two rows of one name in a run
refuse the whole run before anything moves. Names that are empty, absolute or lead out of the folder fail the write.
Null texts are empty files; an empty table is a run without files.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from cuelake.sources.stores import is_file, locate

LISTED = pa.schema([(c, pa.string()) for c in ("file_id", "staged", "sha256", "old_sha256", "backup")])
STATED = "file_id string, sha256 string, backup string, outcome string"


def hash_of(store: fs.FileSystem, path: str) -> str | None:
    """SHA-256 of a file, null where there is none."""
    if not is_file(store, path):
        return None
    digest = hashlib.sha256()
    with store.open_input_stream(path) as file:
        while block := file.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


def put(store: fs.FileSystem, path: str, content: bytes) -> None:
    """Writes a file whole or not at all."""
    store.create_dir(path.rpartition("/")[0], recursive=True)
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(beside) as out:
        out.write(content)
    store.move(beside, path)


def backup_name(path: str, label: str, stamp: str, number: int = 0) -> str:
    """``dir/stem.label.stamp.suffix`` of a path, with a number before the suffix for further ones."""
    folder, slash, name = path.rpartition("/")
    stem, dot, suffix = name.rpartition(".")
    mark = f"{label}.{stamp}" + (f".{number}" if number else "")
    return f"{folder}{slash}{stem or name}.{mark}{dot + suffix if stem else ''}"


def free_backup(store: fs.FileSystem, root: str, name: str, label: str, stamp: str, old: str) -> str:
    """The first backup name that no other content has."""
    number = 0
    while (there := hash_of(store, f"{root}/{backup_name(name, label, stamp, number)}")) not in (None, old):
        number += 1
    return backup_name(name, label, stamp, number)


def checked_name(name: str | None) -> str:
    if not name or name.startswith("/") or any(part in ("", ".", "..") or part.startswith(".staged") for part in name.split("/")):
        raise ValueError(f"not a name below the folder: {name!r}")
    return name


@dataclass
class Staged(WriterCommitMessage):
    """What a task has staged: the address of its list (none: no rows)."""

    listed: str | None


class SubtitleWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, run: str, label: str, stamp: str):
        self.folder, self.run, self.label, self.stamp = folder, run, label, stamp

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        store, root = locate(self.folder)
        # A task's name is new at each attempt: the lists of attempts that failed are never read.
        task = f".staged/{self.run}/{uuid.uuid4().hex}"
        rows = []
        for batch in iterator:
            for name, text in zip(batch.column("file_id").to_pylist(), batch.column("srt").to_pylist(), strict=True):
                content, old = (text or "").encode(), hash_of(store, f"{root}/{checked_name(name)}")
                new = hashlib.sha256(content).hexdigest()
                kept = free_backup(store, root, name, self.label, self.stamp, old) if self.stamp and old not in (None, new) else None
                staged = f"{task}/{len(rows)}"
                put(store, f"{root}/{staged}", content)
                rows.append((name, staged, new, old, kept))
        if not rows:
            return Staged(None)
        listed = f"{task}/list.jsonl"
        lines = "".join(json.dumps(dict(zip(LISTED.names, row, strict=True))) + "\n" for row in rows)
        put(store, f"{root}/{listed}", lines.encode())
        return Staged(listed)

    def commit(self, messages: list[Staged | None]) -> None:
        store, root = locate(self.folder)
        lists = sorted(m.listed for m in messages if m is not None and m.listed)
        put(store, f"{root}/.staged/{self.run}.json", json.dumps({"run": self.run, "lists": lists}).encode())

    def abort(self, messages: list[Staged | None]) -> None:
        remove(*locate(self.folder), self.run)


class SubtitleFiles(DataSource):
    """Writer of subtitle files. Options: path, run (its name; new by default), label and stamp of backups (no stamp: none)."""

    @classmethod
    def name(cls) -> str:
        return "subtitle_files"

    def writer(self, schema: StructType, overwrite: bool) -> SubtitleWriter:
        if not {"file_id", "srt"} <= set(schema.names):
            raise ValueError("rows of subtitle files have file_id and srt")
        o = self.options
        return SubtitleWriter(o["path"].rstrip("/"), o.get("run") or uuid.uuid4().hex, o.get("label") or "backup", o.get("stamp") or "")


def remove(store: fs.FileSystem, root: str, run: str) -> None:
    """Takes away what a run has staged, its announcement last."""
    if store.get_file_info(f"{root}/.staged/{run}").type == fs.FileType.Directory:
        store.delete_dir(f"{root}/.staged/{run}")
    if is_file(store, f"{root}/.staged/{run}.json"):
        store.delete_file(f"{root}/.staged/{run}.json")


def announced(folder: str) -> list[str]:
    """Names of the runs that are announced and not yet done, sorted."""
    store, root = locate(folder)
    there = store.get_file_info(fs.FileSelector(f"{root}/.staged", allow_not_found=True))
    return sorted(f.base_name.removesuffix(".json") for f in there if f.is_file and f.base_name.endswith(".json"))


def put_in_place(store: fs.FileSystem, root: str, row: dict) -> tuple[str | None, str]:
    """Does what a list's row says, or what is left of it; the backup that there is, and the outcome.

    The hashes tell what has been done: the new content in place needs nothing more; the old content in its backup needs no copy.
    """
    path, staged = f"{root}/{row['file_id']}", f"{root}/{row['staged']}"
    there, kept = hash_of(store, path), row["backup"]
    if there != row["sha256"]:
        if there != row["old_sha256"]:
            return None, "changed"
        if not is_file(store, staged):
            return None, "lost"
        if kept and hash_of(store, f"{root}/{kept}") != there:
            with store.open_input_stream(path) as old:
                put(store, f"{root}/{kept}", old.read())
        store.create_dir(path.rpartition("/")[0], recursive=True)
        store.move(staged, path)
    if kept and hash_of(store, f"{root}/{kept}") is None:
        kept = None
    return kept, "unchanged" if row["old_sha256"] == row["sha256"] else "replaced" if row["old_sha256"] else "created"


def publish(spark: SparkSession, folder: str, run: str) -> DataFrame:
    """Makes an announced run true and returns its records (file_id, sha256, backup, outcome). May be repeated at will.

    Outcomes are created, replaced and unchanged; changed, where the file isn't the one that was there at staging; lost, where
    the staged file has gone without reaching its place.
    """
    folder = folder.rstrip("/")
    store, root = locate(folder)
    records = f"{folder}/.records/run={run}"
    if is_file(store, f"{root}/.staged/{run}.json"):
        with store.open_input_stream(f"{root}/.staged/{run}.json") as file:
            lists = json.loads(file.read())["lists"]
        schema = ", ".join(f"{c} string" for c in LISTED.names)
        # Lists are small and many: they are read as one table, and rows are dealt out anew.
        rows = spark.read.schema(schema).json([f"{folder}/{name}" for name in lists]) if lists else spark.createDataFrame([], schema)
        same = rows.groupBy("file_id").count().where("count > 1").first()
        if same is not None:
            remove(store, root, run)
            raise ValueError(f"{same['count']} rows of the run are named {same['file_id']}")

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, root = locate(folder)
            for batch in batches:
                done = [(r["file_id"], r["sha256"], *put_in_place(store, root, r)) for r in batch.to_pylist()]
                names = ("file_id", "sha256", "backup", "outcome")
                yield pa.RecordBatch.from_pylist([dict(zip(names, d, strict=True)) for d in done], pa.schema([(n, pa.string()) for n in names]))

        # The records' own commit is Spark's. If it fails, the announcement is still there and the run is published again.
        rows.repartition("file_id").mapInArrow(place, STATED).write.mode("overwrite").parquet(records)
        remove(store, root, run)
    return spark.read.schema(STATED).parquet(records)


def recover(spark: SparkSession, folder: str) -> list[str]:
    """Publishes all announced runs and removes what runs without an announcement have staged; names of the published ones.

    For the start of a program that is the folder's only writer.
    """
    runs = announced(folder)
    for run in runs:
        publish(spark, folder, run)
    store, root = locate(folder)
    for left in store.get_file_info(fs.FileSelector(f"{root}/.staged", allow_not_found=True)):
        if left.type == fs.FileType.Directory:
            store.delete_dir(left.path)
    return runs


def write_subtitle_files(rendered: DataFrame, folder: str, *, label: str = "backup", stamp: str = "") -> DataFrame:
    """Writes and publishes ``folder/file_id`` for every rendered text (file_id, srt); the records of the run."""
    spark = rendered.sparkSession
    spark.dataSource.register(SubtitleFiles)
    run = uuid.uuid4().hex
    rows = rendered.select(F.col("file_id").cast("string").alias("file_id"), F.col("srt").cast("string").alias("srt"))
    rows.write.format("subtitle_files").mode("append").option("run", run).option("label", label).option("stamp", stamp).save(folder)
    return publish(spark, folder, run)
