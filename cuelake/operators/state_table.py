"""A table of task states: small deltas, and snapshots that they are folded into.

Updates name the fields they change; a micro-batch's updates are one delta, in a folder of its number, so that a batch that is run
again replaces its own delta. Reading folds the last snapshot and the deltas after it, never the whole history. Compaction writes
that fold as a new snapshot, sorted by key so that look-ups skip most of its files, and moves the pointer to it, with the number of
the last delta that it holds, in one step; a compaction that ends earlier has changed nothing. Deltas that the snapshot before last
held are removed, later ones stay for readers under way.

Within a table updates hold in order of their delta, then of ``order`` within it: what arrives later is later. A field is set to
null by naming it in ``cleared``. One program writes a table at a time, as Structured Streaming's checkpoint sees to.
"""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cuelake.sources import versioned
from cuelake.sources.stores import locate

#: Deltas after the snapshot at which a stream's next one is followed by a compaction.
COMPACT_AFTER = 20


class StateTable:
    """States by ``key`` in ``folder``. ``schema`` names all fields: the key, those of ``order``, and what states hold."""

    def __init__(self, spark: SparkSession, folder: str, schema: str | StructType, *, key: str = "key", order: tuple[str, ...] = ("updated_at",)):
        self.spark, self.folder, self.key, self.order = spark, folder.rstrip("/"), key, order
        self.schema = spark.createDataFrame([], schema).schema
        fields = [f for f in self.schema.fields if f.name != key]
        #: A stored row: the key, its number, and for each field its value and whether the row names it.
        self.stored = spark.createDataFrame([], self.schema).select(
            key, *(F.struct(F.col(f.name).alias("value"), F.lit(True).alias("named")).alias(f.name) for f in fields)
        ).withColumn("__batch", F.lit(0).cast("long")).schema

    def _numbers(self) -> list[int]:
        store, root = locate(f"{self.folder}/deltas")
        there = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return sorted(int(f.base_name.removeprefix("batch=")) for f in there if f.type == fs.FileType.Directory and f.base_name.startswith("batch="))

    def _upto(self) -> int:
        return versioned.pointer(f"{self.folder}/snapshots").get("upto", -1)

    def append(self, updates: DataFrame, number: int) -> None:
        """Sets down a delta. Missing fields and nulls aren't named; those listed in a column ``cleared`` (array of names) are, as null."""
        cleared = F.col("cleared") if "cleared" in updates.columns else F.array().cast("array<string>")
        fields = []
        for f in self.schema.fields:
            if f.name != self.key:
                value = (F.col(f.name) if f.name in updates.columns else F.lit(None)).cast(f.dataType)
                named = value.isNotNull() | F.coalesce(F.array_contains(cleared, f.name), F.lit(False))
                fields.append(F.struct(F.when(named, value).alias("value"), named.alias("named")).alias(f.name))
        rows = updates.select(F.col(self.key), *fields).withColumn("__batch", F.lit(number).cast("long"))
        # Many updates of a key in a batch are one row already.
        self._folded(rows).write.mode("overwrite").parquet(f"{self.folder}/deltas/batch={number}")

    def _folded(self, rows: DataFrame) -> DataFrame:
        """A row a key: of each field the last value that a row names."""
        place = F.struct("__batch", *(F.col(c)["value"] for c in self.order))
        last = [F.max_by(F.col(c), F.when(F.col(c)["named"], place)).alias(c) for c in self.schema.names if c != self.key]
        return rows.groupBy(self.key).agg(*last, F.max("__batch").alias("__batch"))

    def _rows(self) -> tuple[DataFrame, int]:
        """Folded rows, and the number of the last delta in them."""
        upto = self._upto()
        held = versioned.read(self.spark, f"{self.folder}/snapshots", self.stored)
        tail = [n for n in self._numbers() if n > upto]
        if tail:
            deltas = self.spark.read.schema(self.stored).parquet(*(f"{self.folder}/deltas/batch={n}" for n in tail))
            held = self._folded(held.unionByName(deltas))
        return held, tail[-1] if tail else upto

    def read(self) -> DataFrame:
        """The state of every key."""
        rows, _ = self._rows()
        return rows.select(self.key, *(F.col(f"{c}.value").alias(c) for c in self.schema.names if c != self.key))

    def tail(self) -> int:
        """Deltas that a reader folds."""
        upto = self._upto()
        return sum(n > upto for n in self._numbers())

    def compact(self) -> int:
        """Folds the deltas so far into a new snapshot; the number of the last one in it."""
        now = versioned.pointer(f"{self.folder}/snapshots")
        rows, upto = self._rows()
        if upto > now.get("upto", -1):
            ordered = rows.repartitionByRange(self.key).sortWithinPartitions(self.key)
            versioned.replace(ordered, f"{self.folder}/snapshots", note={"upto": upto}, base=now["version"], checked=True)
            store, root = locate(f"{self.folder}/deltas")
            for number in self._numbers():
                if number <= now.get("upto", -1):
                    store.delete_dir(f"{root}/batch={number}")
        return upto

    def upsert(self, updates: DataFrame, checkpoint: str, *, compact_after: int = COMPACT_AFTER):
        """Starts a query that takes a stream's updates in, and compacts when many deltas wait."""

        def write(batch: DataFrame, number: int) -> None:
            # A batch that is run again after a compaction that held it changes nothing.
            if number > self._upto():
                self.append(batch, number)
            if self.tail() >= compact_after:
                self.compact()

        return updates.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
