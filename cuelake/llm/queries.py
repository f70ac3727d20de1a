"""The registered ``opN_*`` queries over whole tables, and the DuckDB SQL of those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontaminate,
    importance,
    lang_id,
    license_scan,
    lm_score,
    near_dedup,
    packing,
    quality_classifier,
    quality_rules,
    secret_scan,
    sharding,
    url_filter,
    whitening,
)
from .common import held_out, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id"), 4, 2))
    model = lang_id.fit(docs.where(~F.col("held_out")))
    return lang_id.predict(docs, model, carry=["doc_id", "held_out"])


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id"), 4, 2))
    model = quality_classifier.fit(docs.where(~F.col("held_out")), table(spark, sf_dir, "labels"))
    scored = quality_classifier.predict(docs, model, carry=["doc_id", "held_out"])
    predicted = (F.col("__score") >= quality_classifier.THRESHOLD).cast("int")
    return scored.select("doc_id", "held_out", F.col("__score").alias("score"), predicted.alias("predicted"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_overlap(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"]
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
    )


OP3_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
sizes AS (SELECT DISTINCT least(13, len(w)) AS m FROM item WHERE len(w) > 0),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS m,
         array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
  FROM item, unnest(generate_series(1, greatest(1, len(w) - 12))) AS t(i) WHERE len(w) > 0),
dwin AS (
  SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM doc, sizes, unnest(generate_series(1, len(w) - m + 1)) AS t(i) WHERE len(w) >= m),
occ AS (SELECT r, i, m, item_id FROM dwin JOIN win USING (m, g)),
hits AS (SELECT r, count(DISTINCT p) AS n_hit
         FROM (SELECT DISTINCT r, i, m FROM occ), unnest(generate_series(i, i + m - 1)) AS t(p) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM occ) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
"""


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.stratified_shards(table(spark, sf_dir, "documents"))
    return shards.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
        "fraction",
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id"), 10, 0))
    model = lm_score.fit(docs.where(~F.col("held_out")))
    scored = lm_score.score(docs, model, carry=["doc_id", "held_out"])
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "class_texts", "n_links")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"), carry=["doc_id"])
    of_kind = lambda kind: F.filter("secrets", lambda s: s["kind"] == kind)
    counts = [F.size(of_kind(kind)).cast("long").alias(f"n_{secret_scan.KINDS[kind]}") for kind in range(4)]
    base = secret_scan.as_text(F.filter("secrets", lambda s: s["kind"] < 3))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), secret_scan.as_text(F.col("secrets")).alias("spans"))


def _match_sql(kind: int, pattern: str, group: int) -> str:
    pattern = pattern.replace("'", "''")
    return f"""SELECT r, {kind} AS kind, regexp_extract_all(t, '{pattern}') AS found, regexp_extract_all(t, '{pattern}', {group}) AS inside,
           string_split_regex(t, '{pattern}') AS gaps FROM doc"""


#: The candidates' pattern without its look-behind: a leftmost longest run has no key character before it anyway.
OP11_SQL = rf"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
raw AS ({" UNION ALL ".join(
    _match_sql(kind, pattern, group)
    for kind, pattern, group in (
        (0, secret_scan.ASSIGN, 2), (1, secret_scan.ACCESS, 0), (2, secret_scan.HEX, 0), (3, "[A-Za-z0-9+/_-]{16,}", 0))
)}),
one AS (SELECT r, kind, unnest(found) AS v, unnest(inside) AS g, unnest(gaps[:len(found)]) AS gap, unnest(range(len(found))) AS k
        FROM raw WHERE len(found) > 0),
placed AS (SELECT *, (sum(length(gap) + length(v)) OVER (PARTITION BY r, kind ORDER BY k) - length(v))::BIGINT AS s FROM one),
win AS (
  SELECT r, s, i, substr(v, i + 1, {secret_scan.WINDOW}) AS w
  FROM placed, unnest(range(length(v) - {secret_scan.WINDOW - 1})) AS t(i)
  WHERE kind = 3 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')
    AND NOT regexp_matches(lower(v), '{"|".join(secret_scan.ALLOWED)}')),
weighed AS (
  SELECT r, s, i, w, list_sum(list_transform(list_distinct(string_split(w, '')),
         lambda c: {secret_scan.WEIGHTS}[len(list_filter(string_split(w, ''), lambda d: d = c)) + 1])) AS total
  FROM win),
dense AS (
  SELECT r, s, i FROM weighed
  WHERE length(regexp_replace(w, '[^0-9]', '', 'g')) BETWEEN 1 AND {secret_scan.WINDOW - 1}
    AND total <= CASE WHEN regexp_full_match(w, '[0-9a-fA-F]+') THEN {secret_scan.limit(secret_scan.HEX_LIMIT)}
                      ELSE {secret_scan.limit(secret_scan.ANY_LIMIT)} END),
island AS (
  SELECT r, s, i, sum(new) OVER (PARTITION BY r, s ORDER BY i) AS n
  FROM (SELECT *, (i > coalesce(lag(i) OVER (PARTITION BY r, s ORDER BY i), -{secret_scan.WINDOW + 1}) + {secret_scan.WINDOW})::INT AS new FROM dense)),
span AS (
  SELECT r, kind, s, s + length(v) AS e FROM placed WHERE kind IN (1, 2) OR kind = 0 AND length(g) >= {secret_scan.LEAST_VALUE}
  UNION ALL SELECT r, 3, s + min(i), s + max(i) + {secret_scan.WINDOW} FROM island GROUP BY r, s, n),
named AS (SELECT *, {list(secret_scan.KINDS)}[kind + 1] || ':' || s || ':' || e AS name FROM span),
joined AS (
  SELECT r, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS c,
         count(*) FILTER (kind = 3) AS d, string_agg(name, ',' ORDER BY s, kind) FILTER (kind < 3) AS base,
         string_agg(name, ',' ORDER BY s, kind) AS spans
  FROM named GROUP BY r)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex,
       coalesce(d, 0)::BIGINT AS n_entropy, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM doc LEFT JOIN joined USING (r)
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = rf"""
WITH crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0],
         lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words
  FROM documents),
item AS (
  SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM benchmark),
word AS (SELECT r, unnest(words) AS w FROM doc),
tally AS (SELECT w, count(*) AS n, 0 AS m FROM word GROUP BY w UNION ALL SELECT w, 0, count(*) FROM item GROUP BY w),
spelt AS (SELECT w, sum(n)::BIGINT AS n, sum(m)::BIGINT AS m, hex(encode(w)) AS h FROM tally GROUP BY w),
hashed AS (
  SELECT w, n, m, xor(4294967295, list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(range(1, length(h), 2),
             lambda i: ((strpos('0123456789ABCDEF', substr(h, i, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(h, i + 1, 1)) - 1)::BIGINT)),
           lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % {importance.BUCKETS} AS bucket
  FROM spelt, crc),
counts AS (SELECT bucket, sum(n)::BIGINT AS s, sum(m)::BIGINT AS t FROM hashed GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0)::BIGINT AS ss, coalesce(sum(t), 0)::BIGINT AS tt FROM counts),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (ss + {importance.BUCKETS})::DOUBLE
                                 / ((s + 1)::DOUBLE * (tt + {importance.BUCKETS})::DOUBLE)))::BIGINT AS gain
  FROM counts, totals),
weights AS (SELECT r, sum(gain)::BIGINT AS weight FROM word JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY r),
hex AS (SELECT r, substr(sha256('{importance.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8) AS h FROM doc),
noise AS (
  SELECT r, list_sum(list_transform(range(1, 9), lambda i: (strpos('0123456789abcdef', substr(h, i, 1)) - 1) * power(16, 8 - i))) AS h
  FROM hex),
scored AS (
  SELECT r, doc_id, len(words) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM doc LEFT JOIN weights USING (r) JOIN noise USING (r)),
able AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, r) AS rank, count(*) OVER () AS n
  FROM scored WHERE n_features >= {importance.LEAST_WORDS})
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score,
       CASE WHEN rank <= {importance.PERCENT} * n // 100 THEN rank END AS rank
FROM scored LEFT JOIN able USING (r)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_quality_rules": op2_quality_rules,
        "op3_decontamination": op3_decontamination,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_url_filter": op5_url_filter,
        "op6_sharding": op6_sharding,
        "op7_license_scan": op7_license_scan,
        "op8_packing": op8_packing,
        "op9_lm_score": op9_lm_score,
        "op10_near_dedup": op10_near_dedup,
        "op11_secret_scan": op11_secret_scan,
        "op12_whitening": op12_whitening,
        "op13_importance": op13_importance,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": OP3_SQL, "op11_secret_scan": OP11_SQL, "op13_importance": OP13_SQL}
