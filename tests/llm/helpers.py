"""Odd documents that every operator must take, and plain versions of the contracts' rules."""

import re
import zlib

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use themselves.
CLASHES = "n_words long, kept boolean, row long, node string, key string, score double, shard int, position long, tokens string, h long, __row string, word string, n long"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

PROSE = (
    "the quick brown fox jumps over the lazy dog while seven wizards watch from the old stone bridge and "
    "a small grey cat sleeps near the warm kitchen fire until the evening bell rings twice across town"
)


def odd_rows():
    long_text = " ".join(f"wort{k % 911} {'Ünicode' if k % 7 else '字'}" for k in range(15_000))
    return [
        (1, PROSE, "en", "a", 1),
        (2, PROSE, "en", "a", 1),
        (2, PROSE, "en", "a", 1),
        (3, PROSE.replace("zards", "dows"), "en", "b", None),
        (4, "", "en", "a", 0),
        (5, None, "de", "a", None),
        (5, None, "de", "a", None),
        (6, " \n\t ", None, None, 4),
        (7, "12 !! ## 34", "fr", "b", 3),
        (8, long_text, "de", "c", None),
        (None, "der die das und nicht ein Haus am See", "de", None, 2),
        (9, "ein Wort", "de", "a", 2),
        (10, "K\u212aelvin İ ß ﬁ ² Ⅷ", "de", "a", 2),
        (11, "x" * 5000, "en", "a", 1),
        (12, "same same " * 40, "en", "a", 1),
    ]


def documents(spark, rows=None, clashes=True):
    rows = odd_rows() if rows is None else rows
    extra = (None,) * len(CLASHES.split(", ")) if clashes else ()
    return spark.createDataFrame([(*r, *extra) for r in rows], SCHEMA + (", " + CLASHES if clashes else ""))


def fold(doc_id, modulus, remainder):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % modulus == remainder


def spaced_words(text):
    return SPACED.findall(text or "")


def plain_words(text):
    return PLAIN.findall((text or "").translate(UPPER))


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def folder(spark, tmp_path, **tables):
    for name, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"file://{tmp_path}/{name}.parquet")
    return f"file://{tmp_path}"
