"""More registered queries: bytes, names, checkpoints, states and provider failures, each with its DuckDB twin.

Twins state what must come out, where they can from how the input was made, rather than the operator's steps.
"""

from __future__ import annotations

import io
import wave

import pandas as pd
from pyspark.sql import functions as F

from cuelake import shared
from cuelake.functions import identity, text
from cuelake.operators import enrich, manifest, metrics, sequence, stages, validation
from cuelake.plans.queries import _BLOCK, _CUES, _strip, conversation_cues, event_rows, query, table
from cuelake.sources import positional, sinks, states, subtitle_sink, subtitles


@query(
    "decode_bytes",
    f"""SELECT doc_id, CASE WHEN doc_id % 7 < 5 THEN {_strip("replace(text, chr(13), chr(10))")} END AS text,
CASE doc_id % 7 WHEN 5 THEN 'utf32' WHEN 6 THEN 'nul' END AS error FROM documents WHERE text IS NOT NULL""",
)
def decode_bytes(spark, sf_dir):
    """Whole texts as bytes of seven kinds, read again without being told which."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    kind = F.col("doc_id") % 7
    marked = {1: ("UTF-8", b"\xef\xbb\xbf"), 2: ("UTF-16LE", b"\xff\xfe"), 3: ("UTF-16BE", b"\xfe\xff")}
    content = F.when(kind == 5, F.concat(F.lit(b"\xff\xfe\x00\x00"), F.encode("text", "UTF-16LE")))
    content = content.when(kind == 6, F.concat(F.encode("text", "UTF-8"), F.lit(b"\x00")))
    content = content.when(kind == 4, F.encode(F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n")), "UTF-8"))
    for k, (name, mark) in marked.items():
        content = content.when(kind == k, F.concat(F.lit(mark), F.encode("text", name)))
    content = content.otherwise(F.encode("text", "UTF-8"))
    return docs.select("doc_id", subtitles.decode(content).alias("d")).select("doc_id", "d.text", "d.error")


@query(
    "file_hashes",
    """WITH d AS (SELECT doc_id, encode(text) AS raw, hex(encode(text)) AS hex, octet_length(encode(text)) AS size FROM documents WHERE text IS NOT NULL)
SELECT doc_id, sha256(raw) AS whole, sha256(encode(size::VARCHAR) || unhex(substr(hex, 1, 128)) || CASE WHEN size > 64 THEN unhex(right(hex, 128)) ELSE ''::BLOB END) AS sampled FROM d""",
)
def file_hashes(spark, sf_dir):
    content = F.encode("text", "UTF-8")
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", identity.file_hash(content).alias("whole"), identity.sampled_hash(content, 64).alias("sampled"))


_WAV = {0: (1, 16000, 2, 3), 1: (2, 16000, 2, 3), 2: (1, 8000, 2, 3), 3: (1, 16000, 2, 0), 4: (1, 16000, 1, 3)}


@query(
    "wav_check",
    """SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN NULL WHEN 3 THEN 'empty' WHEN 5 THEN 'unreadable' WHEN 6 THEN 'truncated' ELSE 'format' END AS error FROM documents""",
)
def wav_check(spark, sf_dir):
    def sound(channels: int, rate: int, width: int, frames: int) -> bytes:
        out = io.BytesIO()
        with wave.open(out, "wb") as file:
            file.setnchannels(channels)
            file.setframerate(rate)
            file.setsampwidth(width)
            file.writeframes(bytes(channels * width * frames))
        return out.getvalue()

    kinds = {k: sound(*v) for k, v in _WAV.items()} | {5: b"no sound", 6: sound(*_WAV[0])[:-1]}
    content = F.lit(None).cast("binary")
    for k, raw in kinds.items():
        content = F.when(F.col("doc_id") % 7 == k, F.lit(raw)).otherwise(content)
    return table(spark, sf_dir, "documents").select("doc_id", subtitles.wav_error(content).alias("error"))


@query(
    "output_names",
    """WITH p AS (SELECT page_id, url AS path, coalesce(nullif(regexp_extract(url, '^(.*[^/])\\.[^./]*$', 1), ''), url) AS stem FROM pages)
SELECT page_id, stem || '.de.bilingual.srt' AS output, stem || '.source.en.srt' AS source FROM p""",
)
def output_names(spark, sf_dir):
    name = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", text.output_name(name, F.lit("de"), F.lit("bilingual")).alias("output"), text.source_name(name, F.lit("en")).alias("source")
    )


@query(
    "log_texts",
    f"""SELECT doc_id, text AS plain, substr(replace(replace({_strip("replace(text, chr(10), ' ')")}, 'the ', '[REDACTED]'), 'de', '[REDACTED]'), 1, 800) AS error,
CASE lang WHEN 'en' THEN '英语' WHEN 'fr' THEN '法语' WHEN 'de' THEN '德语' WHEN 'es' THEN '西班牙语' ELSE lang END AS language,
split_part(text || chr(10) || 'translated', chr(10), 2) AS second FROM documents""",
)
def log_texts(spark, sf_dir):
    """Colours off, secrets out, one line of at most 800 characters; labels and second lines."""
    docs = table(spark, sf_dir, "documents")
    coloured = F.concat(F.lit("\x1b[1;31m"), F.col("text"), F.lit("\x1b[0m"))
    both = F.concat(F.col("text"), F.lit("\ntranslated"))
    return docs.select(
        "doc_id",
        text.without_ansi(coloured).alias("plain"),
        text.short_error(F.col("text"), ["de", "the "]).alias("error"),
        text.language_label(F.col("lang")).alias("language"),
        text.second_line(both).alias("second"),
    )


@query(
    "bilingual_files",
    f"""WITH {_CUES} SELECT file_id, min(cue_index * (file_id::BIGINT + 1) % 9) > 0 AS bilingual, bool_and(text <> '') AS valid, bool_and(text <> '' AND file_id::BIGINT % 4 <> 0) AS valid_translated
FROM cues GROUP BY file_id""",
)
def bilingual_files(spark, sf_dir):
    """Cues of two lines, but for some of one; outputs of the source joined in the old way; outputs of the translation alone."""
    cues = conversation_cues(spark, sf_dir)
    number = F.col("file_id").cast("long")
    two = cues.withColumn("text", F.when(F.col("cue_index") * (number + 1) % 9 == 0, "one").otherwise(F.lit("one\ntwo")))
    old = cues.withColumn("text", F.concat("text", F.lit("\ntranslated")))
    alone = cues.withColumn("text", F.when((F.col("text") == "") | (number % 4 == 0), " ").otherwise(F.lit("translated")))
    legacy = validation.validate_translation(cues, old, "en", "bilingual", legacy=True)
    plain = validation.validate_translation(cues, alone, "en", "translated").withColumnRenamed("valid", "valid_translated")
    # A blank source line leaves its output with one line in the end, so it can't be valid.
    filled = cues.groupBy("file_id").agg(F.bool_and(F.col("text") != "").alias("filled"))
    valid = legacy.join(filled, "file_id").select("file_id", (F.col("valid") & F.col("filled")).alias("valid"))
    return validation.is_bilingual(two).join(valid, "file_id").join(plain, "file_id")


@query(
    "percent_done",
    """SELECT user_id, (100 * count(*) FILTER (event_type = 'purchase') // nullif(count(*) FILTER (event_type <> 'view'), 0))::INTEGER AS percent FROM events GROUP BY user_id""",
)
def percent_done(spark, sf_dir):
    jobs = table(spark, sf_dir, "events").groupBy("user_id")
    counts = jobs.agg(F.count_if(F.col("event_type") == "purchase").alias("done"), F.count_if(F.col("event_type") != "view").alias("total"))
    return counts.select("user_id", metrics.percent_done(F.col("done"), F.col("total")).alias("percent"))


@query("first_match", "SELECT event_id, event_type AS phase FROM events WHERE event_type = 'signup' AND event_id = (SELECT min(event_id) FROM events WHERE event_type = 'signup')")
def first_match(spark, sf_dir):
    jobs = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("phase"))
    return sequence.first_match(jobs, "signup", "event_id")


_DATE = "Wed, 21 Oct 2015 07:28:00 GMT"
_NOW = 1445412450.0


@query(
    "retry_advice",
    """SELECT event_id, CASE event_id % 8 WHEN 0 THEN 5.0 WHEN 1 THEN 0.0 WHEN 2 THEN 60.0 WHEN 5 THEN 30.0 WHEN 6 THEN 0.5 END::DOUBLE AS wait,
event_id % 40 + 380 BETWEEN 380 AND 419 AND event_id % 40 + 380 NOT IN (408) AS lasting FROM events""",
)
def retry_advice(spark, sf_dir):
    """How long a Retry-After header asks to wait, and whether a status is worth no other attempt."""
    header = F.expr(f"CASE event_id % 8 WHEN 0 THEN '5' WHEN 1 THEN '-3' WHEN 2 THEN '1000' WHEN 3 THEN 'soon' WHEN 4 THEN '' WHEN 5 THEN '{_DATE}' WHEN 6 THEN ' 0.5 ' END")

    @F.pandas_udf("double")
    def wait(headers: pd.Series) -> pd.Series:
        return pd.Series([enrich.wait_seconds(h, _NOW) for h in headers], dtype="float64")

    @F.pandas_udf("boolean")
    def lasting(status: pd.Series) -> pd.Series:
        return pd.Series([enrich.lasting(enrich.ProviderError("", int(s))) for s in status])

    return table(spark, sf_dir, "events").select("event_id", wait(header).alias("wait"), lasting(F.col("event_id") % 40 + 380).alias("lasting"))


class _Faulty(enrich.OfflineProvider):
    """Merges the lines of a batch that has one of a length that 5 divides; has no answer for such a line."""

    def translate_lines(self, lines: list[str], source: str, target: str) -> list[str]:
        if any(len(line) % 5 == 0 for line in lines):
            return [] if len(lines) == 1 else ["all"]
        return super().translate_lines(lines, source, target)


@query(
    "enrich_degraded",
    f"""WITH {_CUES} SELECT file_id, (row_number() OVER (PARTITION BY file_id ORDER BY cue_index) - 1)::INTEGER AS position,
CASE WHEN length(text) % 5 <> 0 THEN '[de] ' || text END AS translation, CASE WHEN length(text) % 5 = 0 THEN 'format' END AS error FROM cues""",
)
def enrich_degraded(spark, sf_dir):
    """Batches whose answer is malformed are asked line by line; only lines without an answer fail."""
    return enrich.enrich(conversation_cues(spark, sf_dir), _Faulty, "en", "de", batch=4, attempts=1, pause=0.0)


@query(
    "checkpoint_resume",
    f"""WITH {_CUES}, n AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY cue_index) - 1 AS position, (length(text) + cue_index) % 4 <> 0 AS good FROM cues),
f AS (SELECT file_id, count(*) AS total, coalesce(min(position) FILTER (NOT good), count(*)) AS n_done FROM n GROUP BY file_id)
SELECT file_id AS input, CASE WHEN file_id::BIGINT % 3 = 0 THEN 0 ELSE n_done END::INTEGER AS n_done, (total - CASE WHEN file_id::BIGINT % 3 = 0 THEN 0 ELSE n_done END)::BIGINT AS to_do FROM f""",
)
def checkpoint_resume(spark, sf_dir):
    """Results up to the first line without one are written as checkpoints; runs with the same source go on from there, others from 0."""
    cues = conversation_cues(spark, sf_dir)
    inputs = cues.groupBy(F.col("file_id").alias("input")).agg(F.count("*").cast("int").alias("total"))
    key = F.when(F.col("input").cast("long") % 2 == 0, "key").cast("string")
    inputs = inputs.select("input", F.sha2("input", 256).alias("source_sha256"), F.lit("m").alias("model"), "total", key.alias("translation_key"))
    placed = sequence.batches(cues, 4)
    good = (F.length("text") + F.col("cue_index")) % 4 != 0
    results = placed.select(F.col("file_id").alias("input"), "position", F.when(good, F.concat(F.lit("t"), F.col("text"))).alias("translation"))
    held = manifest.checkpoints(inputs, results)
    changed = F.when(F.col("input").cast("long") % 3 == 0, F.sha2(F.lit("changed"), 256)).otherwise(F.col("source_sha256"))
    found = manifest.usable_checkpoints(held, inputs.withColumn("source_sha256", changed))
    n = F.size("translations")
    return found.select("input", n.alias("n_done"), (F.col("total") - n).cast("long").alias("to_do"))


@query(
    "merged_outputs",
    """SELECT user_id, event_type AS path, value AS sha FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""",
)
def merged_outputs(spark, sf_dir):
    updates = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.create_map(F.col("event_type"), F.struct(F.col("value").alias("sha"))).alias("outputs"))
    found = manifest.merged_outputs(updates, "user_id", ("ts", "event_id"))
    return found.select("user_id", F.explode("outputs").alias("path", "record")).select("user_id", "path", "record.sha")


@query(
    "checked_events",
    """WITH e AS (SELECT event_id, user_id, event_type, ts, event_id % 31 = 0 OR event_id % 37 = 0 OR event_id % 41 = 0 AS bad FROM events),
f AS (SELECT user_id, min({'ts': ts, 'event_id': event_id}) AS first_bad FROM e WHERE bad GROUP BY user_id)
SELECT event_id, user_id, CASE WHEN {'ts': ts, 'event_id': event_id} = first_bad THEN 'worker_fatal' ELSE event_type END AS event
FROM e LEFT JOIN f USING (user_id) WHERE first_bad IS NULL OR {'ts': ts, 'event_id': event_id} <= first_bad""",
)
def checked_events(spark, sf_dir):
    n = F.col("event_id")
    events = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "ts", (n % 31 != 0).alias("valid"), F.when(n % 37 != 0, 1).alias("protocol"),
        F.when(n % 41 == 0, "old").otherwise("g").alias("generation"), F.col("event_type").alias("event"),
    )
    return manifest.checked_events(events, "user_id", ["ts", "event_id"], "g").select("event_id", "user_id", "event")


@query(
    "batch_metrics",
    """SELECT user_id % 20 AS batch, count(*) AS total, count(*) FILTER (event_type IN ('view', 'signup', 'error')) AS completed, count(*) FILTER (event_type = 'error') AS failed,
count(*) FILTER (event_type IN ('click', 'purchase')) AS unfinished, 130 AS exit_code, count(*) FILTER (event_type = 'view') AS recognized,
max(epoch_us(ts) / 1e6 + 60.0::DOUBLE) - min(epoch_us(ts) / 1e6) AS elapsed_seconds, true AS stopped FROM events GROUP BY user_id % 20""",
)
def batch_metrics(spark, sf_dir):
    phases = {"view": "complete", "signup": "no_text", "error": "failed", "click": "pending", "purchase": "source_ready"}
    phase = F.create_map(*(F.lit(x) for pair in phases.items() for x in pair))[F.col("event_type")]
    jobs = event_rows(spark, sf_dir).select(
        (F.col("user_id") % 20).alias("batch"), phase.alias("phase"), (F.col("event_type") == "view").alias("recognized"), F.col("at").alias("started"), (F.col("at") + 60.0).alias("ended")
    )
    return metrics.batch_metrics(jobs, "batch", stopped=True)


@query(
    "overdue_stages",
    """SELECT event_id, CASE WHEN event_type = 'view' THEN CASE WHEN value * 10 > 1200 THEN 'init_timeout' END WHEN event_type = 'click' THEN CASE WHEN value * 10 > 600 THEN 'stt_timeout' END END AS failure FROM events""",
)
def overdue_stages(spark, sf_dir):
    running = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_type") == "click", "stt").otherwise("init").alias("stage"), (F.col("event_type") != "view").alias("ready"), (F.col("value") * 10).alias("elapsed")
    )
    return stages.overdue(running, local_seconds=600.0).select("event_id", "failure")


@query("commit_checks", "SELECT doc_id AS input, doc_id % 3 <> 0 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0 AS commit FROM documents")
def commit_checks(spark, sf_dir):
    """Of results, those whose input is still there (7), of the same identity (3) and the same text (5)."""
    n, sha = F.col("input"), F.sha2("text", 256)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("input"), F.col("source").alias("video_identity"), sha.alias("source_sha256"))
    now = docs.where(n % 7 != 0).select(
        "input", F.when(n % 3 == 0, "other").otherwise(F.col("video_identity")).alias("video_identity"), F.when(n % 5 != 0, F.col("source_sha256")).alias("source_sha256")
    )
    return manifest.commit_checked(docs, now).select("input", "commit")


@query(
    "recovered_outputs",
    """SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 = 0 THEN CASE WHEN doc_id % 5 <> 0 THEN 'complete' ELSE 'source_ready' END
  WHEN doc_id % 3 = 0 THEN 'refuse_unknown_output' ELSE 'source_ready' END AS decision, doc_id % 30 IN (6, 12, 18, 24) AS recovered FROM documents""",
)
def recovered_outputs(spark, sf_dir):
    """Outputs (3) that a run wrote but couldn't record: known where it had announced them (2), done where the file is the announced one (not 5)."""
    n = F.col("doc_id")
    yes = {c: F.lit(True) for c in ("source_exists", "source_valid", "output_valid", "identity_matches", "stt_matches", "source_hash_matches", "has_stt_identity")}
    no = {c: F.lit(False) for c in ("is_srt", "force", "retry_no_text", "source_blank", "source_pending_matches", "has_record", "record_matches")}
    own = {"output_exists": n % 3 == 0, "output_pending_matches": n % 2 == 0, "pending_hash_matches": n % 5 != 0, "status": F.lit("source_ready")}
    inputs = table(spark, sf_dir, "documents").select("doc_id", *(c.alias(k) for k, c in (yes | no | own).items()))
    return manifest.due_stage(inputs).select("doc_id", "decision", "recovered")


_FILES = f"""{_CUES}, files AS (
  SELECT file_id, string_agg({_BLOCK}, '' ORDER BY cue_index) AS srt FROM cues GROUP BY file_id)"""


@query(
    "path_hashes",
    f"""WITH {_FILES}, raw AS (SELECT file_id, srt, hex(encode(srt)) AS h, octet_length(encode(srt)) AS size FROM files)
SELECT file_id, size, sha256(srt) AS sha256, 'created' AS outcome, sha256(unhex(hex(encode(size::VARCHAR)) || substr(h, 1, 512) ||
  CASE WHEN size > 256 THEN right(h, 512) ELSE '' END)) AS sample_sha256 FROM raw""",
)
def path_hashes(spark, sf_dir):
    """Conversations written as subtitle files; their hashes read from where the files stand."""
    folder = shared.new_folder(spark, "path-hashes")
    written = subtitle_sink.write_subtitle_files(sinks.render(conversation_cues(spark, sf_dir)), folder)
    paths = written.select("file_id", "outcome", F.concat(F.lit(folder + "/"), F.col("file_id")).alias("path"))
    known = positional.file_identities(paths, sample=256).select("file_id", "outcome", "path", "size", "sample_sha256")
    return positional.file_hashes(known.withColumnRenamed("size", "seen")).where("size = seen").select(
        "file_id", "outcome", "size", "sha256", "sample_sha256"
    )


@query("path_order", "SELECT page_id, row_number() OVER (ORDER BY url, page_id) - 1 AS number FROM pages")
def path_order(spark, sf_dir):
    """Pages numbered in order of their urls, as inputs are in order of their paths."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return shared.numbered(pages, [F.col("url"), F.col("page_id")], "number", "path-order").select("page_id", "number")


@query(
    "keyed_states",
    """WITH e AS (SELECT user_id::VARCHAR AS key, event_type, value, epoch_us(ts) // 1000000 AS secs, event_id FROM events),
one AS (SELECT event_type, key, arg_max(value, event_id) AS value, arg_max(secs, event_id) AS secs, max(event_id) AS last FROM e GROUP BY event_type, key)
SELECT event_type AS file_id, key, CASE WHEN last % 5 = 0 THEN NULL ELSE event_type END AS status,
  CASE WHEN last % 5 IN (0, 1) THEN NULL ELSE secs END AS size, CASE WHEN last % 5 IN (0, 2) THEN NULL ELSE last::VARCHAR END AS sha256,
  CASE WHEN last % 5 = 0 THEN NULL ELSE value END AS unknown FROM one WHERE event_type <> 'view'""",
)
def keyed_states(spark, sf_dir):
    """Events as one state file a type, an object of users; every fifth state is a mere string, others lack a record, one file is broken."""
    rows = event_rows(spark, sf_dir).select("event_type", F.col("user_id").cast("string").alias("key"), "value", F.floor("at").alias("at"), "event_id")
    last = rows.groupBy("event_type", "key").agg(F.max_by(F.struct("value", "at", "event_id"), "event_id").alias("e")).select("event_type", "key", "e.*")
    kind = F.col("event_id") % 5
    record = F.when(kind != 2, F.struct(F.struct(F.col("event_id").cast("string").alias("sha256")).alias("a.srt")))
    video = F.when(kind != 1, F.struct(F.col("at").alias("size"), F.lit("x").alias("mtime_ns")))
    state = F.to_json(F.struct(F.col("event_type").alias("status"), video.alias("video_identity"), record.alias("outputs"), F.col("value").alias("unknown")))
    entry = F.concat(F.lit('"'), F.col("key"), F.lit('":'), F.when(kind == 0, F.lit('"gone"')).otherwise(state))
    files = last.groupBy("event_type").agg(F.concat(F.lit("{"), F.array_join(F.collect_list(entry), ","), F.lit("}")).alias("value"))
    files = files.withColumn("value", F.when(F.col("event_type") == "view", F.substr("value", F.lit(2))).otherwise(F.col("value")))
    found = states.keyed_states(files.withColumnRenamed("event_type", "file_id"))
    return found.select(
        "file_id",
        "key",
        "status",
        F.col("video_identity.size").alias("size"),
        F.try_element_at("outputs", F.lit("a.srt"))["sha256"].alias("sha256"),
        F.try_variant_get("more", "$.unknown", "double").alias("unknown"),
    )


@query(
    "base_urls",
    r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^([hH][tT][tT][pP][sS]?)://([^/?#@:\s]+)(/[^?#\s]*)?([?]?#?)$', ['scheme', 'host', 'path', 'rest']) AS m FROM pages)
SELECT page_id, CASE WHEN m.host <> '' AND NOT ends_with(rtrim(m.path, '/'), '/chat/completions') THEN lower(m.scheme) || '://' || lower(m.host) || rtrim(m.path, '/') END AS url FROM p""",
)
def base_urls(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", identity.base_url(F.col("url"))["url"].alias("url"))
