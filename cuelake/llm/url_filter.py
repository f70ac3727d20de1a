"""URL filters: fixed host and path rules, and association rules mined by FP-growth.

A url's tokens are all labels of its host (numbered from the right), all its path segments (by
place, numbers as one token), the file ending, the names of query parameters and whether there is
a fragment. Urls that a fixed rule decides are the labelled ones: with their verdict as one more
token, and without the tokens that the fixed rules test, which would only repeat those rules, they
are the transactions of Spark's FP-growth. Mined rules whose consequent is ``block`` are kept
if support and confidence suffice and no rule with some of its tokens does as well. Other urls are
blocked if such a rule matches, and allowed otherwise.

Bounds of the fit. FP-growth's item sets double with every token that frequent urls share, as in a
template with thirty parameter names, so baskets are made smaller before it and rules shorter after:

* tokens that stand in exactly the same labelled urls (by count and a sum of row hashes) are one item
  with one representative. No rule is lost by that: of such tokens the rules say the same, and urls
  are matched with the representative in place of each of them.
* of a basket with more items, FP-growth gets the ``BASKET`` that tell most of the verdict (by information
  gain). What that may cut apart is looked for level by level (``combinations``): all combinations of
  up to ``LONGEST`` items of whole baskets, grown only from those that have the support and aren't sure
  already. Equal baskets are one there. With both, no rule of up to ``LONGEST`` tokens is missed.
* rules have at most ``LONGEST`` tokens: that is what a rule is here, whatever a basket's size.

Support and confidence of what is found are then counted anew over the whole baskets.

Matching goes by an inverted index: each rule is listed under the rarest of its tokens, url tokens
are joined to that, and the rule's other tokens are then checked. The rules are broadcast while
there are at most ``BROADCAST_RULES``; beyond that both sides are shuffled by token.

Defined results: a null url, or one without ``://``, has an empty host and path and no rule, and
is judged by its tokens (none: allowed); repeated rows are judged alone; an empty table gives an
empty result; without labelled urls all others are allowed; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: (host, path, verdict) of the fixed rules.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
SUPPORT = 0.005
CONFIDENCE = 0.9
#: Most items of a basket that FP-growth gets, and most tokens in a rule.
BASKET = 12
LONGEST = 4
BROADCAST_RULES = 50_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none does."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, said in sorted(RULES, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """The url's tokens, each once."""
    def numbered(parts: Column, mark: str) -> Column:
        return F.transform(parts, lambda x, i: F.concat(F.lit(mark), i.cast("string"), F.lit(":"), x))

    labels = F.reverse(F.filter(F.split(host, r"\."), lambda x: x != ""))
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    plain = F.transform(segments, lambda x: F.regexp_replace(x, r"\d+", "<n>"))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    names = F.filter(F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, r"^([^=]*)", 1)), lambda x: x != "")
    ending = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,6})$", 1)
    return F.array_distinct(
        F.concat(
            numbered(labels, "host"),
            numbered(plain, "path"),
            F.transform(names, lambda x: F.concat(F.lit("query:"), x)),
            F.when(ending != "", F.array(F.concat(F.lit("ending:"), ending))).otherwise(F.array().cast("array<string>")),
            F.when(url.contains("#"), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
        )
    )


def tested_tokens() -> list[str]:
    """The tokens that the fixed rules test."""
    found = set()
    for host, path, _ in RULES:
        found |= {f"host{k}:{x}" for k, x in enumerate(reversed(host.split(".")))}
        found |= {f"path{k}:{x}" for k, x in enumerate(filter(None, path.split("/")))}
    return sorted(found)


def _entropy(part: Column, whole: Column) -> Column:
    """Bits of a yes in ``part`` of ``whole`` cases, times ``whole``."""
    bits = lambda k: F.when(k > 0, -k * F.log2(k / whole)).otherwise(0.0)
    return bits(part) + bits(whole - part)


def items_of(labelled: DataFrame, support: float) -> DataFrame:
    """token, item (the representative of the tokens in the same urls) and gain (bits about the verdict) of
    the frequent tokens. ``labelled`` has row, tokens and verdict."""
    blocks = (F.col("verdict") == "block").cast("long")
    n, n_block = labelled.agg(F.count("*"), F.coalesce(F.sum(blocks), F.lit(0))).first()
    places = F.xxhash64("row")
    counts = (
        labelled.select("row", blocks.alias("block"), F.explode("tokens").alias("token"))
        .groupBy("token")
        .agg(F.count("*").alias("n"), F.sum("block").alias("k"), F.sum(F.shiftrightunsigned(places, 24)).alias("s1"), F.bit_xor(places).alias("s2"))
        .where(F.col("n") >= support * n)
    )
    items = counts.groupBy("n", "s1", "s2", "k").agg(F.min("token").alias("item"), F.collect_list("token").alias("tokens"))
    left = _entropy(F.lit(n_block) - F.col("k"), F.lit(n) - F.col("n"))
    gain = _entropy(F.lit(float(n_block)), F.lit(float(n))) - _entropy(F.col("k"), F.col("n")) - F.when(F.col("n") < n, left).otherwise(0.0)
    return materialise(items.select("item", gain.alias("gain"), F.explode("tokens").alias("token")), "url-items")


def with_items(urls: DataFrame, items: DataFrame) -> DataFrame:
    """``urls`` (row, tokens) as row and items: structs of minus gain and item, those of the highest gain first."""
    each = urls.select("row", F.explode("tokens").alias("token"))
    held = F.broadcast(items) if _few(items) else items
    found = each.join(held, "token").groupBy("row").agg(F.sort_array(F.collect_set(F.struct((-F.col("gain")).alias("g"), "item"))).alias("items"))
    return found.select("row", F.transform("items", lambda x: x["item"]).alias("items"))


def combinations(labelled: DataFrame, least: float, confidence: float) -> DataFrame:
    """tokens of all combinations of up to ``LONGEST`` items that stand in ``least`` blocked baskets and are sure enough.

    A combination grows by items that come later in the basket, while it has the support and isn't wholly sure: what it becomes
    part of has no more support, and would be beaten by it.
    """
    n, k = F.count("*").alias("n"), F.count_if(F.col("verdict") == "block").alias("k")
    baskets = labelled.groupBy(F.array_sort("items").alias("rest")).agg(n, k)
    rows = baskets.withColumn("tokens", F.array().cast("array<string>"))
    found = []
    for level in range(1, LONGEST + 1):
        each = rows.select("n", "k", "tokens", "rest", F.posexplode("rest").alias("at", "item"))
        rest = F.slice("rest", F.col("at") + 2, F.size("rest"))
        grown = each.select("n", "k", F.array_append("tokens", F.col("item")).alias("tokens"), rest.alias("rest"))
        grown = materialise(grown, "url-grown") if level < LONGEST else grown
        counted = grown.groupBy("tokens").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).where(F.col("k") >= least)
        counted = materialise(counted, "url-combinations")
        found.append(counted.where(F.col("k") / F.col("n") >= confidence).select("tokens"))
        open_ = counted.where(F.col("k") < F.col("n")).select("tokens")
        rows = grown.join(F.broadcast(open_) if _few(open_) else open_, "tokens", "left_semi")
    return reduce(DataFrame.union, found)


def mine(labelled: DataFrame, *, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """rule number, tokens (items), confidence and support of the block rules; ``labelled`` has row, items and verdict."""
    n = labelled.count()
    marks = F.array(F.concat(F.lit("verdict="), F.col("verdict")))
    baskets = labelled.select(F.concat(F.slice("items", 1, BASKET), marks).alias("items"))
    model = FPGrowth(minSupport=support, minConfidence=confidence, itemsCol="items").fit(baskets)
    found = model.associationRules.where(F.array_contains("consequent", "verdict=block")).select(F.array_sort("antecedent").alias("tokens"))
    found = found.where((F.size("tokens") <= LONGEST) & ~F.exists("tokens", lambda x: x.startswith("verdict=")))
    if not labelled.where(F.size("items") > BASKET).isEmpty():
        found = found.union(combinations(labelled, support * n, confidence)).distinct()
    found = materialise(found.withColumn("number", F.monotonically_increasing_id()), "url-rules")
    # Counted over whole baskets: a token that was cut from some counts there as well.
    counted = (
        matched_rules(labelled.select("row", F.col("items").alias("tokens")), found)
        .join(labelled.select("row", "verdict"), "row")
        .groupBy("number")
        .agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "block").alias("k"))
        .select("number", (F.col("k") / F.col("n")).alias("confidence"), (F.col("k") / n).alias("support"))
        .where((F.col("confidence") >= confidence) & (F.col("support") >= support))
    )
    found = materialise(found.join(counted, "number"), "url-rules")
    # A rule goes if one with some of its tokens is as sure. It has at most 2 ** LONGEST - 2 such parts.
    choices = F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.size("tokens")) - 2)
    part = lambda m: F.filter("tokens", lambda x, i: F.call_function("getbit", m, i) == 1)
    beaten = (
        found.where(F.size("tokens") > 1)
        .select("number", F.col("confidence").alias("sure"), F.explode(F.transform(choices, part)).alias("tokens"))
        .join(found.select("tokens", "confidence"), "tokens")
        .where(F.col("confidence") >= F.col("sure"))
        .select("number")
        .distinct()
    )
    return materialise(found.join(beaten, "number", "left_anti"), "url-rules")


def matched_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """row and number for every rule (number, tokens) whose tokens are all among a url's (row, tokens)."""
    few = _few(rules)
    each = rules.select("number", F.explode("tokens").alias("token"))
    # How often a token stands in urls; the rarest of a rule's tokens is its entry.
    named = each.select("token").distinct()
    frequency = (
        urls.select(F.explode("tokens").alias("token"))
        .join(F.broadcast(named) if few else named, "token", "left_semi")
        .groupBy("token")
        .agg(F.count("*").alias("n"))
    )
    entry = (
        each.join(frequency, "token", "left")
        .groupBy("number")
        .agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    )
    index = entry.join(rules.select("number", F.col("tokens").alias("needed")), "number").select("token", "needed", "number")
    index = materialise(index, "url-index")
    looked_up = urls.select("row", "tokens", F.explode("tokens").alias("token")).join(F.broadcast(index) if few else index, "token")
    return looked_up.where(F.size(F.array_except("needed", "tokens")) == 0).select("row", "number")


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """row and sure (the best confidence) for the urls (row, tokens) that a rule matches."""
    return matched_rules(urls, rules).join(rules.select("number", "confidence"), "number").groupBy("row").agg(F.max("confidence").alias("sure"))


def _few(rules: DataFrame) -> bool:
    return rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES


def judge(pages: DataFrame, *, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict and confidence (null without a mined match) of every row."""
    url = F.col("url")
    host, path = split_url(url)
    named = pages.select(F.monotonically_increasing_id().alias("row"), "page_id", F.coalesce(url, F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"))
    rows = named.select("row", "page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    rows = materialise(rows, "urls")
    untested = F.array_except("tokens", F.array(*map(F.lit, tested_tokens())))
    labelled = rows.where("rule is not null").select("row", untested.alias("tokens"), "verdict")
    if labelled.isEmpty():
        found = rows.select("row").limit(0).withColumn("sure", F.lit(None).cast("double"))
    else:
        items = items_of(labelled, support)
        baskets = labelled.select("row", "verdict").join(with_items(labelled, items), "row", "left")
        baskets = materialise(baskets.select("row", "verdict", F.coalesce("items", F.array().cast("array<string>")).alias("items")), "url-baskets")
        rules = mine(baskets, support=support, confidence=confidence)
        others = with_items(rows.where("rule is null").select("row", untested.alias("tokens")), items)
        found = matches(materialise(others.select("row", F.col("items").alias("tokens")), "url-baskets"), rules)
    said = F.coalesce("verdict", F.when(F.col("sure").isNotNull(), "block"), F.lit("allow"))
    return rows.join(found, "row", "left").select("page_id", "host", "path", "rule", said.alias("verdict"), F.col("sure").alias("confidence"))
