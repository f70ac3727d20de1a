import io
import wave

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cuelake.sources import sinks, subtitles

GOOD = "1\n00:00:00,000 --> 00:00:02.500\nHello\nthere\n\n3\n00:00:02,000 --> 00:00:04,000\nAgain"


def parsed(spark, *texts):
    rows = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "file_id string, text string")
    return [tuple(r) for r in subtitles.parse(rows).orderBy("file_id", "cue_index").collect()]


def test_good_file(spark):
    assert parsed(spark, GOOD) == [("0", 1, 0, 2500, "Hello\nthere", None), ("0", 3, 2000, 4000, "Again", None)]


@pytest.mark.parametrize(
    "text, error",
    [
        (GOOD + "\n\nbroken", "malformed"),
        ("1\n00:99:00,000 --> 00:00:02,000\nx", "timestamp"),
        ("1\n00:00:02,000 --> 00:00:02,000\nx", "order"),
        ("intro\n\n" + GOOD, "malformed"),
        ("1\n00:00:00,000 --> 00:00:01,000\na\n\n1\n00:00:01,000 --> 00:00:02,000\nb", "index"),
        ("0\n00:00:00,000 --> 00:00:01,000\na", "index"),
        ("1\n00:00:00,000 --> 00:00:01,000\na\n00:00:01,000 --> 00:00:02,000", "text"),
        (GOOD.replace("\n\n", "\n\n\n\n"), "malformed"),
    ],
)
def test_one_bad_block_rejects_the_file(spark, text, error):
    assert parsed(spark, text) == [("0", None, None, None, None, error)]


def test_two_blank_lines_part_blocks(spark):
    assert len(parsed(spark, GOOD.replace("\n\n", "\n\n\n"))) == 2


LINES = st.text("abc字 .!?", min_size=1, max_size=10).filter(lambda x: x.strip())
CUES = st.lists(st.tuples(st.integers(0, 10**7), st.integers(1, 10**5), LINES), min_size=1, max_size=5)


@settings(max_examples=10, deadline=None)
@given(st.lists(CUES, min_size=1, max_size=4))
def test_parse_undoes_render(spark, files):
    rows = [
        (str(f), k + 1, start, start + length, line.strip())
        for f, cues in enumerate(files)
        for k, (start, length, line) in enumerate(cues)
    ]
    cues = spark.createDataFrame(rows, "file_id string, cue_index int, start_ms long, end_ms long, text string")
    rendered = sinks.render(cues).withColumn("text", F.rtrim(F.regexp_replace("srt", r"\s+\z", "")))
    found = subtitles.parse(rendered).select("file_id", "cue_index", "start_ms", "end_ms", "text")
    assert sorted(map(tuple, found.collect())) == sorted(rows)


@pytest.mark.parametrize(
    "raw, encoding, text, error",
    [
        ("字幕です。".encode("gb18030"), "gb18030", "字幕です。", None),
        ("x字".encode("utf-16"), "auto", "x字", None),
        ("中文字幕".encode("big5"), "auto", None, "ambiguous"),
        ("中文字幕".encode("big5"), "big5", "中文字幕", None),
        ("简体字幕😀".encode("gb18030"), "auto", "简体字幕😀", None),
        ("ab".encode("utf-16-le"), "auto", None, "nul"),
        ("ab".encode("utf-16-le"), "utf-16-le", "ab", None),
        ("ab".encode("utf-32"), "auto", None, "utf32"),
        (b"\xef\xbb\xbfa\r\nb\rc\n", "auto", "a\nb\nc", None),
        (b"\xff", "utf-8", None, "undecodable"),
        (b"\xff\xff", "auto", None, "unknown"),
        (b"a", "latin-1", None, "unsupported"),
    ],
)
def test_decoding(raw, encoding, text, error):
    assert subtitles.decode_bytes(raw, encoding) == (text, error)


def test_files_and_inputs(spark, tmp_path):
    (tmp_path / "a.srt").write_text(GOOD)
    (tmp_path / "empty.srt").write_text("\n")
    (tmp_path / "bad.srt").write_bytes("中文字幕".encode("big5"))
    (tmp_path / "clip.MP4").write_bytes(b"x")
    cues = subtitles.read_cues(spark, str(tmp_path)).collect()
    assert sorted((r["file_id"].rsplit("/", 1)[1], r["error"]) for r in cues) == [
        ("a.srt", None),
        ("a.srt", None),
        ("bad.srt", "ambiguous"),
        ("empty.srt", "empty"),
    ]
    assert [r["path"].rsplit("/", 1)[1] for r in subtitles.scan_inputs(spark, str(tmp_path)).collect()] == ["clip.MP4"]


def test_recordings(spark):
    def sound(rate, frames):
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(rate)
            w.writeframes(b"\0\0" * frames)
        return bytearray(out.getvalue())

    rows = spark.createDataFrame([(sound(16000, 5),), (sound(8000, 5),), (sound(16000, 0),), (bytearray(b"no"),)], "content binary")
    assert [r[0] for r in rows.select(subtitles.wav_error(F.col("content"))).collect()] == [None, "format", "empty", "unreadable"]


def test_numbering_drops_blank_segments(spark):
    rows = [("f", 0, 0.0, 1.0, " "), ("f", 1, 1.0, 2.0005, " a "), ("f", 2, 2.0, 3.0, "b")]
    segments = spark.createDataFrame(rows, "file_id string, seq int, start double, end double, text string")
    found = [tuple(r) for r in sinks.numbered_cues(segments).orderBy("cue_index").collect()]
    assert found == [("f", 1, 1000, round(2.0005 * 1000), "a"), ("f", 2, 2000, 3000, "b")]


def test_records(spark, tmp_path):
    (tmp_path / "state.json").write_text('{"key": "a", "status": "complete"}\nnot json\n"text"\n')
    assert [r["status"] for r in subtitles.read_state(spark, str(tmp_path / "state.json")).collect()] == ["complete"]
    (tmp_path / "events.jsonl").write_text('{"protocol": 1, "event": "job_started"}\noops\n')
    assert sorted(r["valid"] for r in subtitles.read_events(spark, str(tmp_path / "events.jsonl")).collect()) == [False, True]
