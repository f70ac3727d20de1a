"""Cue text as Column expressions: normalisation, joining, phrase filters and names.

All are built-in functions, so they stay inside code generation. Whitespace and line breaks are
those of Unicode as cue files use them, spelt out because ``trim`` and ``\\s`` know only ASCII.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The same characters one by one, for trimming.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
CJK = r"[\u3040-\u30ff\u3400-\u9fff]"
CJK_LANGUAGES = r"^(ja|zh|cmn|yue)"

# Boilerplate that speech recognition invents, and the characters around phrases.
CONSERVATIVE_PHRASES = [
    "Subtitles by",
    "Thank you for watching",
    "Amara.org",
    "ご視聴ありがとうございました",
    "チャンネル登録",
    "字幕制作",
    "字幕提供",
    "字幕翻译提供",
    "字幕制作提供",
    "谢谢观看",
    "感谢观看",
    "请点赞",
    "请订阅",
]
AGGRESSIVE_PHRASES = [
    "Subtitles by",
    "字幕制作",
    "未经作者授权",
    "点赞",
    "订阅",
    "Subscribe",
    "Thank you for watching",
    "观看更多视频",
    "Amara.org",
    "MBC",
    "TBS",
    "ご視聴ありがとうございました",
    "チャンネル登録",
    "高評価",
    "字幕提供",
    "字幕协力",
    "字幕翻译",
    "字幕制作协力",
    "字幕制作提供",
    "谢谢观看",
    "请点赞",
    "请订阅",
    "感谢观看",
    "更多视频",
    "字幕由",
    "字幕翻译提供",
    "下期见",
    "敬请期待",
    "敬请期待下一集",
    "敬请期待下期",
    "敬请期待下集",
    "敬请期待下一回",
    "敬请期待下回",
    "敬请期待后续",
    "敬请期待续集",
    "敬请期待后续内容",
    "敬请期待后续更新",
    "敬请期待后续发展",
    "敬请期待后续剧情",
    "敬请期待后续故事",
    "敬请期待后续事件",
]
PHRASE_EDGES = "。.!！?？…・-—~～"
CLOSERS = ",.!?:;%)]}，。！？；：、"
OPENERS = "([{¿¡"
# Names of languages and codes of their speech.
LANGUAGE_LABELS = {
    "ja": "日语",
    "en": "英语",
    "zh-CN": "简体中文",
    "zh-TW": "繁体中文",
    "ko": "韩语",
    "fr": "法语",
    "de": "德语",
    "it": "意大利语",
    "es": "西班牙语",
}
SPEECH_CODES = {
    "ja": "ja-JP",
    "en": "en-US",
    "zh-CN": "cmn-Hans-CN",
    "zh-TW": "cmn-Hant-TW",
    "ko": "ko-KR",
    "fr": "fr-FR",
    "de": "de-DE",
    "it": "it-IT",
    "es": "es-ES",
}


def _in_class(characters: str) -> str:
    return "".join("\\" + c if c in r"\]^[-&" else c for c in characters)


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def is_blank(text: Column) -> Column:
    return ~text.rlike(rf"[^{SPACE}]")


def text_lines(text: Column) -> Column:
    """Stripped lines that aren't blank."""
    return F.filter(F.transform(F.split(text, LINE_BREAK), strip), lambda x: x != "")


def joins_without_space(language: Column, lines: Column) -> Column:
    mostly_cjk = F.size(F.filter(lines, lambda x: x.rlike(CJK))) * 2 > F.size(lines)
    return language.rlike(CJK_LANGUAGES) | ((language == "auto") & mostly_cjk)


def normalized_text(text: Column, language: Column) -> Column:
    """One line: East Asian lines are joined as they are, others with a space."""
    return bind(
        text_lines(text), lambda lines: F.when(joins_without_space(language, lines), F.array_join(lines, "")).otherwise(F.array_join(lines, " "))
    )


def join_words(words: Column, language: Column) -> Column:
    """Words to text: East Asian as they are; else with spaces, but for punctuation that clings."""

    def spaced(parts: Column) -> Column:
        def led(part: Column, k: Column) -> Column:
            opened = F.get(parts, k - 1).rlike(rf"[{_in_class(OPENERS)}]\z")
            clings = (k == 0) | part.rlike(rf"^[{_in_class(CLOSERS)}]") | opened
            return F.concat(F.when(clings, "").otherwise(" "), part)

        return F.array_join(F.transform(parts, led), "")

    # Only the neighbour before decides about the space, so no fold is needed. The array binds the parts once.
    parts = F.filter(F.transform(words, strip), lambda x: x != "")
    return F.when(language.rlike(CJK_LANGUAGES), F.array_join(words, "")).otherwise(F.transform(F.array(parts), spaced)[0])


def normalized_phrase(text: Column) -> Column:
    return F.lower(F.btrim(strip(text), F.lit(PHRASE_EDGES)))


def phrase_pattern(phrases: list[str]) -> str:
    """A pattern that finds any of the phrases, as a tree of their characters: shared beginnings are tried once.

    A phrase that holds another one is found by that one. What may come first is one class, so most places of a text cost one test.
    """
    least = sorted({p for p in phrases if not any(q != p and q in p for q in phrases)})

    def tree(endings: list[str]) -> str:
        # No ending is the beginning of another: that one would have been dropped.
        if len(endings) == 1:
            return re.escape(endings[0])
        heads = sorted({e[0] for e in endings})
        return "(?:" + "|".join(re.escape(h) + tree([e[1:] for e in endings if e[0] == h]) for h in heads) + ")"

    return f"(?=[{_in_class(''.join(sorted({p[0] for p in least})))}]){tree(least)}"


def is_hallucination(text: Column, mode: str = "conservative") -> Column:
    """Blank text always is; ``conservative`` compares whole phrases, ``aggressive`` also looks inside."""
    if mode not in ("off", "conservative", "aggressive"):
        raise ValueError(f"unknown filter mode: {mode}")
    plain = [p.strip().strip(PHRASE_EDGES).casefold() for p in CONSERVATIVE_PHRASES]
    inside = phrase_pattern([p.casefold() for p in AGGRESSIVE_PHRASES])

    def judged(bare: Column) -> Column:
        found = bare == ""
        if mode == "off":
            return found
        # Only a text as short as a phrase, but for its edges, is lowered to be compared.
        core = F.btrim(bare, F.lit(PHRASE_EDGES))
        found = found | F.when(F.length(core) <= max(map(len, plain)), F.lower(core).isin(plain)).otherwise(False)
        if mode == "conservative":
            return found
        for opening, closing in ("()", "（）", "[]"):
            found = found | (F.startswith(bare, F.lit(opening)) & F.endswith(bare, F.lit(closing)))
        return found | F.lower(bare).rlike(inside)

    return bind(strip(text), judged)


def invented(texts: pa.Array, mode: str = "conservative") -> np.ndarray:
    """``is_hallucination`` of an Arrow array of texts, for tasks that judge each distinct text once; null counts as invented."""
    if mode not in ("off", "conservative", "aggressive"):
        raise ValueError(f"unknown filter mode: {mode}")
    as_mask = lambda x: x.to_numpy(zero_copy_only=False)
    bare = pc.utf8_trim(texts.fill_null(""), characters=SPACES)
    found = as_mask(pc.equal(bare, ""))
    if mode == "off":
        return found
    lowered = [x.lower() for x in bare.to_pylist()]
    plain = pa.array(p.strip().strip(PHRASE_EDGES).casefold() for p in CONSERVATIVE_PHRASES)
    found = found | as_mask(pc.is_in(pc.utf8_trim(pa.array(lowered, pa.string()), characters=PHRASE_EDGES), value_set=plain))
    if mode == "conservative":
        return found
    for opening, closing in ("()", "（）", "[]"):
        found |= as_mask(pc.and_(pc.starts_with(bare, opening), pc.ends_with(bare, closing)))
    # One search through all of them: no phrase holds the line feed that stands between two.
    inside = re.compile(phrase_pattern([p.casefold() for p in AGGRESSIVE_PHRASES]))
    ends = np.cumsum([len(x) + 1 for x in lowered])
    hits = [m.start() for m in inside.finditer("\n".join(lowered))]
    found[np.searchsorted(ends, np.array(hits, np.int64), side="right")] = True
    return found


def is_language_tag(value: Column, *, allow_auto: bool = False) -> Column:
    ok = strip(value).rlike(r"^[a-zA-Z]{2,3}(?:-[a-zA-Z0-9]{2,8})*\z")
    return ok | (strip(value) == "auto") if allow_auto else ok


def language_label(value: Column) -> Column:
    return _looked_up(value, LANGUAGE_LABELS, value)


def speech_code(value: Column, default: Column) -> Column:
    return _looked_up(value, SPEECH_CODES, default)


def _looked_up(value: Column, names: dict[str, str], default: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(F.try_element_at(pairs, value), default)


def without_code_fence(text: Column) -> Column:
    """Markdown fences around a model's answer, removed."""
    opened = F.regexp_replace(strip(text), rf"^```(?:json)?[{SPACE}]*", "")
    return F.regexp_replace(opened, rf"[{SPACE}]*```\z", "")


def safe_name(text: Column) -> Column:
    name = F.btrim(F.regexp_replace(text, r"[^A-Za-z0-9_.-]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("default"))


def short_error(text: Column, secrets: list[str] = ()) -> Column:
    """One line of at most 800 characters, secrets replaced, longest first."""
    out = strip(F.replace(text, F.lit("\n"), F.lit(" ")))
    for secret in sorted({s for s in secrets if s}, key=len, reverse=True):
        out = F.replace(out, F.lit(secret), F.lit("[REDACTED]"))
    return F.substring(out, 1, 800)


def without_ansi(text: Column) -> Column:
    return F.regexp_replace(text, r"\x1b\[[0-?]*[ -/]*[@-~]", "")


def second_line(text: Column) -> Column:
    """The translation of a bilingual cue; null if there is none."""
    return F.get(F.split(text, "\n"), F.lit(1))


def output_name(source: Column, language: Column, mode: Column) -> Column:
    """``dir/stem.language.mode.srt`` of a source path."""
    return F.concat_ws(".", F.regexp_replace(source, r"(?<=[^/])\.[^./]*\z", ""), language, mode, F.lit("srt"))


def source_name(video: Column, language: Column) -> Column:
    return F.concat(F.regexp_replace(video, r"(?<=[^/])\.[^./]*\z", ""), F.lit(".source."), language, F.lit(".srt"))
