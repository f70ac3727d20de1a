"""Secret scans of texts in DataFrame functions only.

Fixed patterns find assignments to telling names, access keys and long hex runs. Beside them, every run of 16 or more key characters
(letters, digits, ``+ / _ -``) is a candidate whose Shannon entropy is followed through a sliding window of 16 characters. The
counts of the window's characters are carried along, a digit string in a fold: each step lowers the count of the character that leaves and
raises that of the one that enters, and the sum of c * log2(c) changes by two differences. Sums are in millionths, as integers,
so that they don't drift. A window's limit depends on the narrowest class that holds its characters: hex digits, or any; windows
without a digit (words) or of digits alone (numbers) and candidates without a letter are never secrets. Overlapping windows above their limit are one span of kind
``entropy``, unless its candidate is on the allow-list (placeholders, alphabets, UUIDs).

One pass, no shuffle; a text's work is in proportion to its length. Positions count code points, ends are exclusive.

Defined results: a null or empty text has no spans (the digest is that of the empty text); repeated rows are rows of their own;
matches of one kind never overlap, those of different kinds may, and equal starts are ordered by kind (assign, access, hex,
entropy); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind


def either_case(pattern: str) -> str:
    """The pattern with each ASCII letter in either case, in classes: no engine folds other letters into them."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in pattern)


ASSIGN = (
    "(" + either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
LEAST_VALUE = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}"
#: Every assignment holds one of these in its lowered text; to look for them is cheaper than to try the pattern everywhere.
ASSIGN_HINTS = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 16
#: Bits a character from which a window counts, by class. Of random windows over hex digits 89 % have 2.8 or more, of random ones
#: over 32 characters 92 % have 3.4 or more.
HEX_LIMIT = 2.8
ANY_LIMIT = 3.4
#: Candidates that hold one of these, in either case, are known not to be secrets.
ALLOWED = (
    "example", "placeholder", "changeme", "xxxx", "0123456789", "1234567890", "abcdefghij", "deadbeef",
    "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
)

#: c * log2(c) in millionths, for counts up to the window's length.
WEIGHTS = [round(1e6 * c * math.log2(c)) if c else 0 for c in range(WINDOW + 1)]
#: Matches whose places are summed one after another; longer lists are summed in blocks of so many.
RUN = 256


def limit(bits: float) -> int:
    """The largest sum of weights at which a window has that many bits a character."""
    return WEIGHTS[WINDOW] - round(1e6 * WINDOW * bits)


def running_sums(values: Column) -> Column:
    """For every place of an array of longs, the sum of the values before it; in blocks, so that the work doesn't grow with the square."""

    def before(block: Column, start: Column) -> Column:
        first = F.struct(start.cast("long").alias("sum"), F.array().cast("array<bigint>").alias("all"))
        step = lambda s, v: F.struct((s["sum"] + v).alias("sum"), F.concat(s["all"], F.array(s["sum"])).alias("all"))
        return F.aggregate(block, first, step, lambda s: s["all"])

    total = lambda block: F.aggregate(block, F.lit(0).cast("long"), lambda s, v: s + v)

    def whole(values: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / RUN)), lambda b: F.slice(values, b * RUN + 1, RUN))

        def placed(blocks: Column) -> Column:
            starts = before(F.transform(blocks, total), F.lit(0))
            return F.flatten(F.zip_with(blocks, starts, before))

        return bind(blocks, placed)

    return bind(values, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(F.array().cast("array<bigint>")))


def matches(text: Column, pattern: str, group: int = 0, hint: Column | None = None) -> Column:
    """start, end and the group's text of all matches, leftmost first and never overlapping, as an array of structs.

    Spark returns matches without their places; these follow from the lengths of the pieces between matches. Texts for which ``hint``
    is false are known to have none.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.split(text, pattern, -1)

    def placed(found: Column, gaps: Column) -> Column:
        lengths = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: (F.length(g) + F.length(m)).cast("long"))
        starts = F.zip_with(running_sums(lengths), F.slice(gaps, 1, F.size(found)), lambda s, g: s + F.length(g))
        ends = F.zip_with(starts, found, lambda s, m: s + F.length(m))
        return F.arrays_zip(starts.alias("start"), ends.alias("end"), inner.alias("value"))

    some = F.transform(F.array(F.struct(found.alias("found"), gaps.alias("gaps"))), lambda x: placed(x["found"], x["gaps"]))[0]
    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    likely = text.rlike(pattern) if hint is None else hint & text.rlike(pattern)
    return F.when(likely, some).otherwise(none)


def dense_windows(candidate: Column) -> Column:
    """from and to of the maximal runs of windows above their limit, counted from the candidate's start."""
    weights = F.array(*(F.lit(w).cast("long") for w in WEIGHTS))
    count = lambda counts, code: F.ascii(F.substr(counts, code + 1, F.lit(1))) - 48
    put = lambda counts, code, n: F.overlay(counts, F.char(n + 48), code + 1, F.lit(1))
    is_digit = lambda code: code.between(48, 57).cast("int")
    is_hex_letter = lambda code: (code.between(97, 102) | code.between(65, 70)).cast("int")
    none = F.array().cast("array<struct<from:int,to:int>>")

    def leave(s: Column, code: Column) -> Column:
        return bind(
            F.struct(s.alias("s"), count(s["counts"], code).alias("c")),
            lambda x: F.struct(
                put(x["s"]["counts"], code, x["c"] - 1).alias("counts"),
                (x["s"]["sum"] - weights[x["c"]] + weights[x["c"] - 1]).alias("sum"),
                (x["s"]["digits"] - is_digit(code)).alias("digits"),
                (x["s"]["letters"] - is_hex_letter(code)).alias("letters"),
                x["s"]["begun"].alias("begun"),
                x["s"]["to"].alias("to"),
                x["s"]["runs"].alias("runs"),
            ),
        )

    def enter(s: Column, code: Column, i: Column) -> Column:
        counted = bind(
            F.struct(s.alias("s"), count(s["counts"], code).alias("c")),
            lambda x: F.struct(
                x["s"].alias("s"),
                put(x["s"]["counts"], code, x["c"] + 1).alias("counts"),
                (x["s"]["sum"] - weights[x["c"]] + weights[x["c"] + 1]).alias("sum"),
                (x["s"]["digits"] + is_digit(code)).alias("digits"),
                (x["s"]["letters"] + is_hex_letter(code)).alias("letters"),
            ),
        )

        def judged(x: Column) -> Column:
            most = F.when(x["digits"] + x["letters"] == WINDOW, limit(HEX_LIMIT)).otherwise(limit(ANY_LIMIT))
            above = (i >= WINDOW - 1) & x["digits"].between(1, WINDOW - 1) & (x["sum"] <= most)
            s, start = x["s"], (i - (WINDOW - 1)).cast("int")
            # A run is open from ``begun`` to ``to``; it is put away when a window above the limit starts beyond it.
            new = above & (start > s["to"])
            return F.struct(
                x["counts"].alias("counts"),
                x["sum"].alias("sum"),
                x["digits"].alias("digits"),
                x["letters"].alias("letters"),
                F.when(new, start).otherwise(s["begun"]).alias("begun"),
                F.when(above, start + WINDOW).otherwise(s["to"]).alias("to"),
                F.when(new & (s["to"] > 0), F.concat(s["runs"], F.array(F.struct(s["begun"].alias("from"), s["to"].alias("to")))))
                .otherwise(s["runs"])
                .alias("runs"),
            )

        return bind(counted, judged)

    def fold(codes: Column) -> Column:
        first = F.struct(
            F.lit("0" * 128).alias("counts"),
            F.lit(0).cast("long").alias("sum"),
            F.lit(0).alias("digits"),
            F.lit(0).alias("letters"),
            F.lit(0).alias("begun"),
            F.lit(-1).alias("to"),
            none.alias("runs"),
        )

        def step(s: Column, i: Column) -> Column:
            left = F.when(i >= WINDOW, leave(s, codes[F.greatest(i - WINDOW, F.lit(0))])).otherwise(s)
            return bind(left, lambda s: enter(s, codes[i], i))

        last = lambda s: F.when(s["to"] > 0, F.concat(s["runs"], F.array(F.struct(s["begun"].alias("from"), s["to"].alias("to"))))).otherwise(s["runs"])
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), first, step, last)

    codes = F.transform(F.filter(F.split(candidate, ""), lambda c: c != ""), F.ascii)
    return bind(codes, fold)


def spans(text: Column, *, allowed: tuple[str, ...] = ALLOWED) -> Column:
    """All spans of a text (never null), ordered by start and kind, as an array of structs start, kind (0 to 3), end."""
    as_span = lambda m, kind: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"))
    hint = reduce(or_, [F.lower(text).contains(h) for h in ASSIGN_HINTS])
    assign = F.transform(F.filter(matches(text, ASSIGN, 2, hint), lambda m: F.length(m["value"]) >= LEAST_VALUE), lambda m: as_span(m, 0))
    access = F.transform(matches(text, ACCESS), lambda m: as_span(m, 1))
    hexes = F.transform(matches(text, HEX), lambda m: as_span(m, 2))
    listed = "(?i)" + "|".join(allowed) if allowed else "(?!)"
    open_ = F.filter(
        matches(text, CANDIDATE), lambda m: m["value"].rlike("[0-9]") & m["value"].rlike("[A-Za-z]") & ~m["value"].rlike(listed)
    )
    dense = F.flatten(
        F.transform(
            open_,
            lambda m: F.transform(
                dense_windows(m["value"]),
                lambda w: F.struct((m["start"] + w["from"]).alias("start"), F.lit(3).alias("kind"), (m["start"] + w["to"]).alias("end")),
            ),
        )
    )
    return F.array_sort(F.concat(assign, access, hexes, dense))


def as_text(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"], s["end"])), ",")


def scan(docs: DataFrame, *, carry: list[str], allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """The columns ``carry`` and ``secrets``, the array of spans, of every row."""
    return docs.select(*(F.col(c) for c in carry), spans(F.coalesce(F.col("text"), F.lit("")), allowed=allowed).alias("secrets"))
