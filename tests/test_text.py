import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cuelake.functions import identity, text, timecodes

SAMPLES = st.lists(st.text("ab \t\n\r\x0b\x0c\x1c\x1e\x1f\x85　 字か.", max_size=12), min_size=20, max_size=20)


def column(spark, values, expression):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r[0] for r in rows.orderBy("k").select(expression(F.col("v"))).collect()]


def plain_line(value, language):
    lines = [x.strip() for x in value.splitlines() if x.strip()]
    cjk = sum(bool(re.search(text.CJK, x)) for x in lines)
    dense = language.startswith(("ja", "zh", "cmn", "yue")) or (language == "auto" and cjk * 2 > len(lines))
    return ("" if dense else " ").join(lines)


@settings(max_examples=8, deadline=None)
@given(SAMPLES)
def test_one_line_as_in_python(spark, values):
    for language in ("en", "ja", "auto"):
        found = column(spark, values, lambda v, g=language: text.normalized_text(v, F.lit(g)))
        assert found == [plain_line(v, language) for v in values]


@settings(max_examples=8, deadline=None)
@given(SAMPLES)
def test_strip_as_in_python(spark, values):
    assert column(spark, values, text.strip) == [v.strip() for v in values]


def test_words_cling(spark):
    rows = spark.createDataFrame([(["Hello", "world", "!"],), (["(", "see", ")", "now"],), ([" ", "a"],), ([],)], "w array<string>")
    assert [r[0] for r in rows.select(text.join_words(F.col("w"), F.lit("en"))).collect()] == ["Hello world!", "(see) now", "a", ""]
    assert [r[0] for r in rows.limit(1).select(text.join_words(F.col("w"), F.lit("cmn-Hans-CN"))).collect()] == ["Helloworld!"]


@pytest.mark.parametrize(
    "said, conservative, aggressive",
    [
        ("はい", False, False),
        ("(music)", False, True),
        ("Thank you for watching!", True, True),
        ("please subscribe now", False, True),
        ("ご視聴ありがとうございました。", True, True),
        ("  ", True, True),
    ],
)
def test_phrase_filter(spark, said, conservative, aggressive):
    modes = {"off": not said.strip(), "conservative": conservative, "aggressive": aggressive}
    for mode, wanted in modes.items():
        assert column(spark, [said], lambda v, m=mode: text.is_hallucination(v, m)) == [wanted]
    with pytest.raises(ValueError):
        text.is_hallucination(F.lit("x"), "loose")


def test_names_tags_and_errors(spark):
    assert column(spark, ["a b/c", "__", "ok.srt"], text.safe_name) == ["a_b_c", "default", "ok.srt"]
    assert column(spark, ["en", "zh-CN", "e", "auto"], text.is_language_tag) == [True, True, False, False]
    assert column(spark, ["auto"], lambda v: text.is_language_tag(v, allow_auto=True)) == [True]
    assert column(spark, ["ja", "xx"], text.language_label) == ["日语", "xx"]
    assert column(spark, ["ja", "xx"], lambda v: text.speech_code(v, F.lit("und"))) == ["ja-JP", "und"]
    assert column(spark, ["key\nsecret key"], lambda v: text.short_error(v, ["key", "secret key"])) == ["[REDACTED] [REDACTED]"]
    assert column(spark, ["```json\n[1]\n```", "[1]"], text.without_code_fence) == ["[1]", "[1]"]
    assert column(spark, ["\x1b[31mred\x1b[0m"], text.without_ansi) == ["red"]
    assert column(spark, ["d/a.b.mp4"], lambda v: text.output_name(v, F.lit("de"), F.lit("bilingual"))) == ["d/a.b.de.bilingual.srt"]
    assert column(spark, ["d/a.mp4"], lambda v: text.source_name(v, F.lit("ja"))) == ["d/a.source.ja.srt"]


def test_timestamps(spark):
    values = ["00:00:01.500", "100:59:59,999", "00:60:00,000", "00:00:1,000", "٠٠:00:01,000"]
    assert column(spark, values, timecodes.to_milliseconds) == [1500, 363599999, None, None, None]
    rows = spark.createDataFrame([(-1.0,), (0.0005,), (0.0015,), (3600.0,), (360000.25,)], "s double")
    found = [r[0] for r in rows.select(timecodes.format_timestamp(F.col("s"))).collect()]
    assert found == ["00:00:00,000", "00:00:00,000", "00:00:00,002", "01:00:00,000", "100:00:00,250"]


def test_identities(spark):
    rows = spark.createDataFrame([('q"uo\n字', None)], "b string, a string")
    found = rows.select(identity.json_identity(b=F.col("b"), a=F.col("a"))).first()[0]
    assert found == identity.identity({"b": 'q"uo\n字', "a": None})
    a = identity.translation_identity(identity.TranslationSettings(model="m"), "h", "auto", "de")
    assert a == identity.translation_identity(identity.TranslationSettings(model="m"), "h", "auto", "de", "auto")
    assert a != identity.translation_identity(identity.TranslationSettings(model="m"), "h", "auto", "de", "big5")
    assert identity.output_identity(a, "bilingual") != identity.output_identity(a, "translated")
    assert identity.stt_identity({}) != identity.stt_identity({"whisper_model": "small"})
    assert identity.normalize_base_url("HTTPS://API.Example.com:443/v1/") == "https://api.example.com/v1"
    for bad in ("ftp://x", "http://u:p@x/", "http://x/?q", "http://x/v1/chat/completions", "http://x:0/", "http://a b/"):
        with pytest.raises(ValueError):
            identity.normalize_base_url(bad)


def test_phrases_are_found_as_one_by_one(spark):
    phrases = [p.casefold() for p in text.AGGRESSIVE_PHRASES]
    pattern = text.phrase_pattern(phrases)
    # Parts of phrases in a row: beginnings that go wrong, phrases within phrases, phrases one after another.
    rng = random.Random(3)
    parts = [p[:k] for p in phrases for k in range(1, len(p) + 1)] + [p[k:] for p in phrases for k in range(len(p))] + [" ", "x", "s", "m"]
    samples = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(3000)] + phrases
    wanted = [any(p in s for p in phrases) for s in samples]
    assert [bool(re.search(pattern, s)) for s in samples] == wanted and 500 < sum(wanted) < 2900
    assert column(spark, samples, lambda v: v.rlike(pattern)) == wanted


def test_edges_of_any_length_and_long_texts(spark):
    samples = ["。" * 5000 + "谢谢观看" + "~" * 5000, "!" * 9, "　" * 4000, "x" * 5000 + "MbC", "thank you for watching " * 2]
    assert column(spark, samples, text.is_hallucination) == [True, False, True, False, False]
    assert column(spark, samples, lambda v: text.is_hallucination(v, "aggressive")) == [True, False, True, True, True]
    assert column(spark, [None], text.is_hallucination) == [None]
