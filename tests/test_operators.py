import json
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from cuelake.operators import enrich, long_files, manifest, metrics, sequence, validation

SEGMENTS = "file_id string, seq int, start double, end double, text string"
WORDS = "file_id string, seq int, word string, start double, end double"
CUES = "file_id string, cue_index int, start_ms long, end_ms long, text string"


def test_segment_limits(spark):
    rows = [("f", 0, "今日", 0.0, 0.5), ("f", 1, "は", 0.6, 1.0), ("f", 2, "晴", 2.0, 2.4), ("f", 3, "れです", 2.5, 4.5)]
    words = spark.createDataFrame(rows, WORDS)
    for run in (sequence.segment_words, long_files.segment_long_files):
        found = run(words, max_chars=4, max_seconds=1.5, max_gap=0.5).orderBy("seq").collect()
        assert [(r["start"], r["end"], r["text"]) for r in found] == [(0.0, 1.0, "今日は"), (2.0, 2.4, "晴"), (2.5, 4.5, "れです")]


def test_duplicates_are_judged_by_the_last_kept(spark):
    rows = [("f", 0, 0.0, 1.0, "x"), ("f", 1, 1.05, 2.0, " x"), ("f", 2, 2.05, 3.0, "x"), ("f", 3, 3.05, 4.0, "y")]
    segments = spark.createDataFrame(rows, SEGMENTS)
    assert sorted(r["seq"] for r in sequence.drop_near_duplicates(segments).collect()) == [0, 2, 3]


def test_filter_comes_before_duplicates(spark):
    rows = [("f", 0, 0.0, 1.0, "x"), ("f", 1, 1.0, 1.05, "Thank you for watching"), ("f", 2, 1.05, 2.0, "x")]
    kept, summary = sequence.clean_segments(spark.createDataFrame(rows, SEGMENTS))
    assert [r["seq"] for r in kept.collect()] == [0]
    assert summary.select("total", "hallucinations", "duplicates", "segments").first() == (3, 1, 1, 1)


def test_index_and_batches(spark):
    rows = [("a", 0, 1), ("a", 1, 3), ("b", 0, 2), ("b", 1, 2), ("c", 0, 0)]
    found = sequence.index_rises(spark.createDataFrame(rows, "file_id string, position int, cue_index int")).collect()
    assert {r["file_id"]: r["rises"] for r in found} == {"a": True, "b": False, "c": False}
    cues = spark.createDataFrame([("a", k, 0, 1, "x") for k in range(1, 8)], CUES)
    done = spark.createDataFrame([("a", 2)], "file_id string, n_done int")
    assert [(r["position"], r["batch"]) for r in sequence.batches(cues, 2, done).orderBy("position").collect()] == [(2, 0), (3, 0), (4, 1), (5, 1), (6, 2)]


def test_validation(spark):
    source = spark.createDataFrame([("f", 1, 0, 1, "one\ntwo"), ("f", 2, 1, 2, "b")], CUES)

    def verdict(rows, mode="bilingual", **more):
        return validation.validate_translation(source, spark.createDataFrame(rows, CUES), "en", mode, **more).first()["valid"]

    good = [("f", 1, 0, 1, "one two\nT"), ("f", 2, 1, 2, "b\nT")]
    assert verdict(good)
    assert not verdict(good, legacy=True)
    assert verdict([("f", 1, 0, 1, "onetwo\nT"), good[1]], legacy=True)
    assert not verdict([("f", 1, 0, 1, "changed\nT"), good[1]])
    assert not verdict([("f", 1, 0, 2, "one two\nT"), good[1]])
    assert not verdict([*good, ("f", 3, 2, 3, "c\nT")])
    assert not verdict(good[:1])
    assert verdict([("f", 1, 0, 1, "T"), ("f", 2, 1, 2, "T")], "translated")
    assert not verdict([("f", 1, 0, 1, " "), ("f", 2, 1, 2, "T")], "translated")
    cues = spark.createDataFrame(good, CUES)
    assert validation.is_bilingual(cues).first()["bilingual"] and not validation.is_bilingual(source).first()["bilingual"]
    targets = spark.createDataFrame([("a", "X.srt"), ("b", "x.srt"), ("c", "y.srt")], "input string, target string")
    assert [tuple(r) for r in validation.output_collisions(targets).collect()] == [("x.srt", 2)]


def test_checkpoints(spark):
    schema = "version int, source_sha256 string, model string, total int, translations array<string>, translation_key string"
    held = [
        (3, "h1", "m", 3, ["a", "b"], "k"),
        (2, "h2", "m", 3, ["a"], "k"),
        (3, "h3", "m", 3, ["a", " "], "k"),
        (3, "h4", "m", 1, ["a", "b"], "k"),
        (3, "h5", "other", 3, ["a"], "k"),
        (2, "h6", "m", 3, ["a"], None),
        (3, "h7", "m", 3, ["a", None], "k"),
    ]
    wanted = [(h[1], "m", 1 if h[1] == "h4" else 3, h[5]) for h in held]
    found = manifest.usable_checkpoints(
        spark.createDataFrame(held, schema),
        spark.createDataFrame(wanted, "source_sha256 string, model string, total int, translation_key string"),
    )
    assert {r["source_sha256"]: len(r["translations"]) for r in found.collect()} == {"h1": 2, "h2": 0, "h3": 0, "h4": 0, "h5": 0, "h6": 1, "h7": 0}


def test_states(spark):
    rows = [("a", 1, "pending", None), ("a", 2, None, "boom"), ("b", 1, "complete", None)]
    states = spark.createDataFrame(rows, "key string, updated_at int, status string, error string")
    assert sorted(map(tuple, manifest.latest(states).collect())) == [("a", 2, None, "boom"), ("b", 1, "complete", None)]
    assert sorted(tuple(r) for r in manifest.merged(states).select("key", "status", "error").collect()) == [("a", "pending", "boom"), ("b", "complete", None)]
    jobs = spark.createDataFrame([("complete",), ("failed",), ("pending",)], "phase string")
    assert metrics.exit_code(metrics.phase_counts(jobs)).first()["exit_code"] == 1
    assert metrics.exit_code(metrics.phase_counts(jobs), stopped=True).first()["exit_code"] == 130
    assert spark.range(1).select(metrics.percent_done(F.lit(2), F.lit(3))).first()[0] == 66


class Scripted:
    """A provider that answers as told, line by line."""

    def __init__(self, fails):
        self.fails, self.asked = fails, []

    def translate_lines(self, lines, source, target):
        self.asked.append(list(lines))
        return self.fails(lines)

    def close(self):
        pass


def test_malformed_batch_is_asked_line_by_line():
    provider = Scripted(lambda lines: ["t"] if len(lines) == 1 and lines[0] != "bad" else [])
    assert enrich.translate_batch(provider, ["a", "bad", "c"], "en", "de", attempts=1) == [("t", None), (None, "format"), ("t", None)]
    assert provider.asked == [["a", "bad", "c"], ["a"], ["bad"], ["c"]]


def test_retries():
    waits, states = [], [503, 429, None]

    def request():
        status = states.pop(0)
        if status:
            raise enrich.ProviderError("busy", status, "7" if status == 429 else None)
        return ["ok"]

    assert enrich.with_retries(request, 3, 2.0, waits.append) == ["ok"] and waits == [2.0, 7.0]
    for status in (400, 401, 403, 404):
        calls = []

        def refused(status=status, calls=calls):
            calls.append(1)
            raise enrich.ProviderError("no", status)

        with pytest.raises(enrich.ProviderError):
            enrich.with_retries(refused, 5, 0.0, waits.append)
        assert len(calls) == 1
    assert enrich.wait_seconds("1e9") == 60.0 and enrich.wait_seconds("-3") == 0.0
    assert enrich.wait_seconds("nonsense") is None and enrich.wait_seconds(None) is None
    assert enrich.wait_seconds("Wed, 21 Oct 2015 07:28:00 GMT") == 0.0


ANSWERS = [
    ('["a", "b"]', None),
    ('```json\n["a", "b"]\n```', None),
    ('["a"]', "count"),
    ('["a", " "]', "item"),
    ('["a", 1]', "item"),
    ('{"translations": ["a", "b"]}', "shape"),
    ("nope", "json"),
    ("", "empty"),
]


def test_answers(spark):
    rows = spark.createDataFrame(ANSWERS, "answer string, wanted string")
    assert rows.select(enrich.answer_error(F.col("answer"), F.lit(2)).alias("e"), "wanted").where("not (e <=> wanted)").collect() == []
    for answer, wanted in ANSWERS:
        if wanted:
            with pytest.raises(enrich.FormatError):
                enrich.read_answer(answer, 2)
        else:
            assert enrich.read_answer(answer, 2) == ["a", "b"]
    assert enrich.read_answer('{"translations": ["a"]}', 1, wrapped=True) == ["a"]
    with pytest.raises(enrich.FormatError):
        enrich.read_answer('{"translations": ["a"], "more": 1}', 1, wrapped=True)


def test_http_provider():
    answers = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append((self.path, self.headers.get("Authorization"), json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            status, body = answers.pop(0)
            self.send_response(status)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *args):
            pass

    seen = []
    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}/v1"
        provider = enrich.create_provider("openai_compatible", base_url=url, model="m", key="k", mode="json_schema")
        choice = lambda content, **more: {"choices": [{"message": {"content": content}, **more}]}
        answers.append((200, choice('{"translations": ["A"]}')))
        assert provider.translate_lines(["a"], "en", "de") == ["A"]
        assert seen[0][:2] == ("/v1/chat/completions", "Bearer k") and seen[0][2]["response_format"]["type"] == "json_schema"
        for bad in ({"choices": []}, choice("no"), choice('{"translations": ["A"]}', finish_reason="length")):
            answers.append((200, bad))
            with pytest.raises(enrich.FormatError):
                provider.translate_lines(["a"], "en", "de")
        answers.append((401, {}))
        assert enrich.translate_batch(provider, ["a"], "en", "de", pause=0.0) == [(None, "status_401")]
    finally:
        server.shutdown()
    with pytest.raises(ValueError):
        enrich.create_provider("unknown")


def test_enrichment_resumes(spark):
    cues = spark.createDataFrame([("f", k, 0, 1, f"l{k}") for k in range(1, 6)], CUES)
    done = spark.createDataFrame([("f", 3)], "file_id string, n_done int")
    found = enrich.enrich(cues, enrich.OfflineProvider, "en", "de", batch=1, done=done).orderBy("position").collect()
    assert [tuple(r) for r in found] == [("f", 3, "[de] l4", None), ("f", 4, "[de] l5", None)]
    zipped = validation.zip_translations(cues, found and spark.createDataFrame([("f", 1, "t")], "file_id string, position int, translation string"))
    assert {r["error"] for r in zipped.collect()} == {"count"}
