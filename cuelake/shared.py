"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; an own one only where that is unset and Spark is one local process (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """An unused address in the shared folder. What is written there goes with the application."""
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: lineage ends here, a lost executor costs a re-read."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list, number: str, name: str) -> DataFrame:
    """``df`` with gapless numbers from 0 in a total order, without a window over the table.

    Rows are shuffled into ranges of the order and sorted there; the written rows hold their range and their place in it, and a
    range's first number is the size of the ranges before. The order must part all rows that may not be swapped.
    """
    from pyspark.sql import functions as F

    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id())
    placed = materialise(placed, name)
    # The upper bits of the place number the range, the lower 33 the row.
    part = F.shiftright("__place", 33)
    before, total = [], 0
    for row in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():
        before.append((row["part"], total))
        total += row["n"]
    starts = df.sparkSession.createDataFrame(before, "__part long, __before long")
    place = F.col("__place").bitwiseAND((1 << 33) - 1)
    joined = placed.join(F.broadcast(starts), part == F.col("__part"))
    return joined.withColumn(number, F.col("__before") + place).drop("__part", "__before", "__place")
