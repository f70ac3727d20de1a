"""Sharding by proportional stratified interleaving, in DataFrame functions only.

Rows are shuffled by a seeded hash of their id and their place in the table and ranked within their source; the rank r of n gives the
fraction (r + 0.5) / n. Sorted by that fraction, the sources interleave in proportion, so cutting
the order into equal runs gives every shard the mixture of the whole to within a row a source.

No window spans a source or the table. The hash falls evenly into buckets; a row's rank is the
number of rows in lower buckets (sums of counts) plus its place within its own (source, bucket).
Fractions are spread evenly by construction, so the global order is numbered the same way. A
source with a third of all rows therefore takes as many tasks as its rows deserve, as does an id
with a third of all rows (null, say), since the place parts equal ids; only ids, sizes and hashes
are shuffled, never texts.

Defined results: a null text has size 1 and the CRC of the empty text; null sources form one
stratum; repeated rows are rows of their own; an empty table gives an empty result; other columns
are ignored. The law kept is ``rows``: counts of shards differ by at most one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

SHARDS = 16
SEED = 17
#: Buckets of the hash and of the fractions. Fixed, so that the running sums over buckets stay
#: small; 4096 hold about five million rows each at 20 billion documents.
BUCKETS = 4096


def shuffle_hash(seed: int):
    """60 bits of md5 over seed, id and place (``at``): even, the same in every engine."""
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("at").cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def stratified_shards(docs: DataFrame, *, shards: int = SHARDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, source, size, text_crc32, fraction, position, shard and slot of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # The place is stored with the hash, so every later step sees the same.
    rows = docs.select("doc_id", "source", "text", F.monotonically_increasing_id().alias("at")).select(
        "doc_id",
        "source",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        shuffle_hash(seed).alias("h"),
    ).withColumn("hb", (F.col("h") / F.lit((1 << 60) // buckets)).cast("int"))
    rows = materialise(rows, "shard-rows")

    counts = rows.groupBy("source", "hb").agg(F.count("*").alias("n"))
    by_source = Window.partitionBy("source")
    counts = counts.select(
        F.col("source").alias("s"),
        F.col("hb").alias("b"),
        (F.sum("n").over(by_source.orderBy("hb")) - F.col("n")).alias("before"),
        F.sum("n").over(by_source).alias("of"),
    )
    place = F.row_number().over(Window.partitionBy("source", "hb").orderBy("h", "doc_id", "text_crc32", "size"))
    ranked = (
        rows.withColumn("place", place)
        .join(counts, F.col("source").eqNullSafe(F.col("s")) & (F.col("hb") == F.col("b")))
        .withColumn("fraction", (F.col("before") + F.col("place") - F.lit(0.5)) / F.col("of"))
        .withColumn("fb", F.floor(F.col("fraction") * buckets).cast("int"))
        .select("doc_id", "source", "size", "text_crc32", "h", "fraction", "fb")
    )
    ranked = materialise(ranked, "shard-ranks")

    # At most ``buckets`` rows: the running sum over all of them is one small task.
    totals = ranked.groupBy("fb").agg(F.count("*").alias("n"))
    totals = totals.select(
        F.col("fb").alias("b"),
        (F.sum("n").over(Window.orderBy("fb")) - F.col("n")).alias("before"),
        F.sum("n").over(Window.partitionBy()).alias("of"),
    )
    place = F.row_number().over(
        Window.partitionBy("fb").orderBy("fraction", "h", "source", "doc_id", "text_crc32", "size")
    )
    position = (F.col("before") + F.col("place") - 1).cast("long")
    return (
        ranked.withColumn("place", place)
        .join(F.broadcast(totals), F.col("fb") == F.col("b"))
        .withColumn("position", position)
        .withColumn("shard", F.expr(f"position * {shards} div of").cast("int"))
        .withColumn("slot", F.expr(f"position - ((shard * of + {shards - 1}) div {shards})").cast("long"))
        .select("doc_id", "source", "size", "text_crc32", "fraction", "position", "shard", "slot")
    )
