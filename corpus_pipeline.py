"""From raw documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept, and, but for the
last, returns rows of ``docs`` with the columns of ``docs``. ``run`` writes each stage's rows to
the shared folder and reads them again, so a lost executor repeats one stage's tasks at most.
Columns of ``docs`` that are named like an operator's own are passed through untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm import decontaminate, near_dedup, packing, quality_classifier, quality_rules
from cuelake.llm.common import held_out, materialise, table


def _whole_rows(docs: DataFrame) -> DataFrame:
    """The rows as one column, beside the columns that operators read."""
    return docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("__row"), "doc_id", "text", "lang", "source")


def reject_outliers(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or are outliers of their language and source go.

    Statistics are taken once and written beside the rows; no text is shuffled.
    """
    stats = materialise(quality_rules.statistics(_whole_rows(docs), ["__row", "lang", "source"]), "text-statistics")
    return quality_rules.judge(stats, quality_rules.fit(stats)).where("kept").select("__row.*")


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the classifier's threshold go. Rows of the evaluation fold aren't learned from."""
    rows = _whole_rows(docs)
    model = quality_classifier.fit(rows.where(~held_out(F.col("doc_id"), 4, 2)), table(spark, sf_dir, "labels"))
    scored = quality_classifier.predict(rows, model, carry=["__row"])
    return scored.where(F.col("__score") >= quality_classifier.THRESHOLD).select("__row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near or exact copies stays: the one of the least id. Null texts all stay.

    Groups are found and rows chosen by the id and the row's place alone; whole rows are moved once, to
    be held against the chosen places. A repeated row is a copy of itself.
    """
    placed = docs.withColumn("__at", F.monotonically_increasing_id())
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("__at").alias("at"))
    found = near_dedup.near_duplicates(placed.select(key.alias("doc_id"), "text"))
    chosen = found.where("representative").select(F.col("doc_id.at").alias("__chosen"))
    return placed.join(chosen, F.col("__at") == F.col("__chosen"), "left_semi").drop("__at")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages in a twentieth of their words or more go; from others such passages go.

    A text that passages are cut from is cut in ``text``, and counted anew in ``n_chars`` where there is such a column.
    """
    found = decontaminate.find_overlap(_whole_rows(docs), table(spark, sf_dir, "benchmark"), carry=["__row"], clean=True)
    cut = {"text": F.col("cleaned_text"), "n_chars": F.length("cleaned_text")}
    fields = [
        F.coalesce(cut[c].cast(docs.schema[c].dataType), F.col(f"__row.`{c}`")).alias(c) if c in cut else F.col(f"__row.`{c}`").alias(c)
        for c in docs.columns
    ]
    return found.where(~F.col("contaminated")).select(*fields)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences, neighbours on the curve together."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", reject_outliers),
    ("quality classifier", reject_low_quality),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: The classifier and the curve are beyond SQL; tests compare the stages with plain versions of their rules.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
