"""The outputs of all runs so far, kept where look-ups need them.

A look-up joins what is wanted now, which is little, with all that was ever made. As a table bucketed by the identity that look-ups
compare, the history is dealt out once, when it is written: its side of every look-up, both aggregates and joins, stays in place, and only
the wanted rows are shuffled, to the history's buckets. Where the wanted side is small against the history, Spark's runtime filters
(``spark.sql.optimizer.runtime.bloomFilter``) skip most of the history's rows before the join.

Appends add files to the buckets. An empty history answers every look-up with null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cuelake import schemas
from cuelake.operators.manifest import cache_lookup

KEY = "translation_identity"
#: Buckets of a table: some 200 MB each at ten billion outputs. A table keeps the number that it was made with.
BUCKETS = 4096
SCHEMA = f"{schemas.OUTPUT}, actual_sha256 string, valid boolean"


class OutputHistory:
    """Outputs (path, translation_identity, output_identity, sha256; actual_sha256 and valid as last checked) in the table ``name``."""

    def __init__(self, spark: SparkSession, name: str, buckets: int = BUCKETS):
        self.spark, self.name, self.buckets = spark, name, buckets
        if not spark.catalog.tableExists(name):
            self._write(spark.createDataFrame([], SCHEMA))

    def _write(self, rows: DataFrame) -> None:
        rows.write.mode("append").bucketBy(self.buckets, KEY).sortBy(KEY, "path").format("parquet").saveAsTable(self.name)

    def append(self, outputs: DataFrame) -> None:
        """Adds outputs. Rows are dealt to buckets before they are written, so a write makes a file a bucket at most."""
        names = self.spark.createDataFrame([], SCHEMA).columns
        self._write(outputs.select(*names).repartition(self.buckets, KEY))

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def cached(self, wanted: DataFrame) -> DataFrame:
        """Wanted outputs (path, translation_identity) with cached_path, the first other output of the same translation (null: none)."""
        return cache_lookup(wanted, self.read())
