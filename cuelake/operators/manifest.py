"""What is known of earlier runs, and which stage is due for each input.

States are rows keyed by input; the latest of a key holds. All look-ups are equi-joins, and the
decision is one CASE over the joined row, so it is planned for all inputs at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(states: DataFrame, key: str = "key", order: tuple[str, ...] = ("updated_at",)) -> DataFrame:
    """The last row of each key."""
    last = F.max_by(F.struct(*states.columns), F.struct(*order)).alias("__s")
    return states.groupBy(F.col(key).alias("__key")).agg(last).select("__s.*")


def merged(states: DataFrame, key: str = "key", order: tuple[str, ...] = ("updated_at",)) -> DataFrame:
    """Per key, the last non-null value of every column: updates name only the fields they change."""
    rest = [c for c in states.columns if c != key]
    by = F.struct(*order)
    return states.groupBy(key).agg(*(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), by)).alias(c) for c in rest))


def merged_outputs(states: DataFrame, key: str = "key", order: tuple[str, ...] = ("updated_at",)) -> DataFrame:
    """Per key, the records of all its output paths as a map: updates name only the paths they change, the last of a path holds."""
    each = states.select(key, F.explode("outputs").alias("path", "record"), F.struct(*order).alias("__by"))
    last = each.groupBy(key, "path").agg(F.max_by("record", "__by").alias("record"))
    return last.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("path", "record"))).alias("outputs"))


def checkpoints(inputs: DataFrame, results: DataFrame) -> DataFrame:
    """Checkpoints of inputs (input, source_sha256, model, total, translation_key) from results so far (input, position from 0, translation).

    A checkpoint holds the translations up to the first position without one; inputs without any have none.
    The version is 3 with a translation_key, else 2.
    """
    has_text = F.coalesce(F.col("translation").rlike(r"\S"), F.lit(False))
    place = F.row_number().over(Window.partitionBy("input").orderBy("position")) - 1
    leading = results.where(has_text).withColumn("__place", place).where(F.col("position") == F.col("__place"))
    held = leading.groupBy("input").agg(F.sort_array(F.collect_list(F.struct("position", "translation"))).alias("rows"))
    version = F.when(F.col("translation_key").isNotNull(), 3).otherwise(2)
    translations = F.transform("rows", lambda r: r["translation"])
    return inputs.join(held, "input").select(
        "input", version.alias("version"), "source_sha256", "model", "total", translations.alias("translations"), "translation_key"
    )


def usable_checkpoints(checkpoints: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted inputs (source_sha256, model, total, translation_key) with the valid results that they can go on from.

    A checkpoint counts if everything agrees, all its results have text and there aren't too many.
    """
    own = checkpoints.where(
        (F.col("version") == F.when(F.col("translation_key").isNotNull(), 3).otherwise(2))
        & (F.size("translations") <= F.col("total"))
        & F.forall("translations", lambda t: F.coalesce(t.rlike(r"\S"), F.lit(False)))
    )
    keys = ["source_sha256", "model", "total", "translation_key"]
    own = own.select(*(F.col(k).alias(f"c_{k}") for k in keys), "translations")
    on = [F.col(k).eqNullSafe(F.col(f"c_{k}")) for k in keys]
    found = wanted.join(own, on[0] & on[1] & on[2] & on[3], "left").drop(*(f"c_{k}" for k in keys))
    return found.withColumn("translations", F.coalesce("translations", F.array().cast("array<string>")))


def cache_lookup(wanted: DataFrame, outputs: DataFrame) -> DataFrame:
    """Wanted outputs (path, translation_identity) with the first other output that holds the same translation.

    ``outputs`` has path, translation_identity, sha256, and of the file there now actual_sha256 and valid.
    """
    good = outputs.where(F.col("valid") & (F.col("sha256") == F.col("actual_sha256")))
    # The two first paths of an identity do for every wanted path, so no identity's outputs meet all its wants.
    first = good.groupBy("translation_identity").agg(F.min("path").alias("first"))
    second = good.join(first, "translation_identity").where(F.col("path") != F.col("first"))
    second = second.groupBy("translation_identity").agg(F.min("path").alias("second"))
    held = first.join(second, "translation_identity", "left")
    other = F.when(F.col("first") == F.col("path"), F.col("second")).otherwise(F.col("first"))
    return wanted.select("path", "translation_identity").distinct().join(held, "translation_identity", "left").select("path", "translation_identity", other.alias("cached_path"))


def due_stage(inputs: DataFrame) -> DataFrame:
    """``inputs`` with decision: complete, no_text, source_ready, pending, or refuse_* with the reason.

    Columns read: is_srt, force, retry_no_text; source_exists, source_valid, source_blank; output_exists,
    output_valid (against the source); and of the state joined by input: identity_matches,
    stt_matches, source_hash_matches, source_pending_matches, status, has_stt_identity, has_record
    (an output record of this path), record_matches (its identities and hash agree). Where there are such columns,
    output_pending_matches (an output was announced for this path and these identities) and
    pending_hash_matches (the file has the announced hash) let a run go on that ended between writing an
    output and recording it; recovered says that the announcement decided.
    """
    c = F.col
    adopted = c("identity_matches") & ~c("force") & c("source_exists") & c("source_pending_matches")
    status = F.when(adopted, F.when(c("source_valid"), "source_ready").otherwise("no_text")).otherwise(c("status"))
    stt = c("stt_matches") | adopted
    source_known = c("source_hash_matches") | (adopted & c("source_valid"))
    reusable = c("is_srt") | (c("identity_matches") & c("source_valid") & stt & source_known)
    empty = ~c("source_exists") | (~c("source_valid") & c("source_blank"))
    kept_output = c("output_exists") & ~c("force")
    announced = [c(n) if n in inputs.columns else F.lit(False) for n in ("output_pending_matches", "pending_hash_matches")]
    pending = c("identity_matches") & reusable & ~c("force") & announced[0]
    has_record = c("has_record") | pending
    record_matches = F.when(pending, announced[1]).otherwise(c("record_matches"))
    decision = (
        F.when(c("is_srt") & ~c("source_valid"), "refuse_invalid_input")
        .when(adopted & ~c("source_valid") & ~c("source_blank"), "refuse_interrupted_source")
        .when(kept_output & c("identity_matches") & reusable & record_matches & c("output_valid"), "complete")
        .when(kept_output & ~(c("identity_matches") & has_record), "refuse_unknown_output")
        .when(~c("is_srt") & ~c("force") & ~c("retry_no_text") & c("identity_matches") & empty & (status == "no_text") & stt, "no_text")
        .when(
            c("source_valid") & ~reusable & ~c("is_srt") & ~c("force")
            & ~(c("identity_matches") & (c("has_stt_identity") | adopted) & source_known),
            "refuse_unknown_source",
        )
        .when(
            c("source_exists") & ~c("source_valid") & ~c("is_srt") & ~c("force") & ~c("retry_no_text")
            & ~(c("identity_matches") & (status == "no_text") & empty),
            "refuse_empty_source",
        )
        .when(c("is_srt") | (reusable & ~c("force")), "source_ready")
        .otherwise("pending")
    )
    decided = inputs.withColumn("decision", decision)
    return decided.withColumn("recovered", (F.col("decision") == "complete") & pending)


def commit_checked(results: DataFrame, now: DataFrame) -> DataFrame:
    """Results (input, video_identity, source_sha256 as read at the start) with commit: input and source are still the same.

    ``now`` has the same columns as they are at the commit; an input that is gone isn't committed, a source of no hash is compared as such.
    """
    held = now.select("input", F.col("video_identity").alias("__v"), F.col("source_sha256").alias("__s"), F.lit(True).alias("__there"))
    same = F.col("video_identity").eqNullSafe(F.col("__v")) & F.col("source_sha256").eqNullSafe(F.col("__s"))
    return results.join(held, "input", "left").withColumn("commit", F.coalesce(F.col("__there"), F.lit(False)) & same).drop("__v", "__s", "__there")


def checked_events(events: DataFrame, worker: str, order: list[str], generation: str, protocol: int = 1) -> DataFrame:
    """Events (valid, protocol, generation, event) of each worker up to its first that isn't of this protocol and generation.

    That one becomes a ``worker_fatal``; what the worker says after it is not read.
    """
    window = Window.partitionBy(worker).orderBy(*order)
    good = F.col("valid") & (F.col("protocol") == protocol) & (F.col("generation") == generation)
    marked = events.withColumn("__bad", ~F.coalesce(good, F.lit(False)))
    earlier = F.coalesce(F.max("__bad").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    read = marked.withColumn("__late", earlier).where(~F.col("__late"))
    return read.withColumn("event", F.when(F.col("__bad"), "worker_fatal").otherwise(F.col("event"))).drop("__bad", "__late")


def current_events(events: DataFrame, workers: DataFrame) -> DataFrame:
    """Events of the generation and attempt that each job is in now; late ones of older attempts go."""
    now = workers.select("job_id", F.col("generation").alias("__g"), F.col("attempt").alias("__a"))
    held = events.join(now, "job_id")
    return held.where((F.col("generation") == F.col("__g")) & (F.col("attempt") == F.col("__a"))).drop("__g", "__a")


def retry_decisions(failures: DataFrame, most_per_file: int = 1, most_restarts: int = 2) -> DataFrame:
    """Failures (batch, job, at, seq) with retried: within both the file's and the batch's budget, in order."""
    batch = Window.partitionBy("batch").orderBy("at", "seq")
    job = Window.partitionBy("batch", "job").orderBy("at", "seq")
    counted = failures.withColumn("restarts", F.row_number().over(batch) - 1).withColumn("tries", F.row_number().over(job) - 1)
    return counted.withColumn("retried", (F.col("tries") < most_per_file) & (F.col("restarts") < most_restarts))
