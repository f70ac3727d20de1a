"""Quality rules by robust multivariate outliers, in DataFrame functions only.

Each text gives a vector of transformed statistics. For every language and source the minimum
(regularised) covariance determinant is estimated. From three starts (medians with median
deviations; mean and covariance; medians with the spatial sign covariance) concentration steps keep
the ``SUBSET`` share of vectors nearest by Mahalanobis distance and re-estimate mean and covariance
from them, until no determinant falls any more; the start with the least determinant is kept. Its
covariance is widened by the consistency factor of a normal sample cut at that share.

* Estimates of small groups lean on their language's, and those on that of all: of n vectors, the
  estimate counts n times and the wider one, pooled from the groups' kept vectors, ``LEAN`` times.
  That is continuous in n; every group's own vectors count.
* A text is rejected if its squared distance exceeds ``CUT``, the chi-square quantile ``QUANTILE``.
* Equal vectors of a language and source count once in the fit, so that a much-copied text can't
  draw the estimate onto itself.
* The matrix ``FLOORS``, what a careful writer may vary by, is added to every covariance (the
  regularisation), as most texts agree exactly in some statistics, such as having no symbols at all.
* Text is read once; only vectors are kept and aggregated, with partial aggregates, so a source with a
  third of all rows is no one task's work. Estimates are a row a group; they are broadcast while
  there are at most ``BROADCAST_GROUPS``. Beyond that they are joined by shuffle, where Spark splits hot keys.

The repeat count compares windows of five words by 64-bit hashes of hashes; within a text of a
million windows two different ones agree with a probability of 3e-8.

Defined results: a null text has no words and fails the base rule, as does an empty one; null
languages and sources are groups of their own; repeated rows get equal verdicts, and so do ties (a
distance equal to the cut is kept); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, materialise

LEAST_WORDS = 10
#: Percent of words in repeated windows above which the base rule fails.
MOST_REPEATED = 20
WINDOW = 5

DIMENSIONS = 6
SUBSET = 0.75
#: Most concentration steps; determinants fall with each, and some ten do on all tables seen.
STEPS = 20
#: How many vectors the wider estimate counts for.
LEAN = 30
BROADCAST_GROUPS = 20_000
#: Least standard deviations of the statistics, in order: what a careful writer may vary by.
FLOORS = (0.12, 0.2, 0.15, 0.2, 0.1, 0.1)
#: Squared distance beyond which a vector is an outlier: the chi-square quantile of ``QUANTILE`` with 6 degrees.
QUANTILE = 0.999
CUT = 22.458
#: SUBSET over the share of chi-square with 8 degrees below the SUBSET quantile (7.841) with 6: makes the covariance consistent.
CONSISTENCY = 1.3615

#: Ordinary words and lines that every text is thought to have besides its own, as short texts vary more.
PRIOR_WORDS = 20
PRIOR_LINES = 2

_SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, _SPACE), "")


def repeated_words(tokens: Column) -> Column:
    """Words inside windows of five that are found twice or more in the text, the first included."""

    def covered(windows: Column) -> Column:
        places = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

        def same(ranked: Column) -> Column:
            twice = F.filter(
                ranked,
                lambda s, k: (F.get(ranked, k - 1)["h"] == s["h"]).__or__(F.get(ranked, k + 1)["h"] == s["h"]),
            )
            return F.sort_array(F.transform(twice, lambda s: s["i"]))

        def total(at: Column) -> Column:
            each = F.transform(at, lambda p, k: F.coalesce(F.least(F.lit(WINDOW), p - F.get(at, k - 1)), F.lit(WINDOW)))
            return F.aggregate(each, F.lit(0), lambda a, n: a + n)

        return F.when(
            F.size(F.array_distinct(windows)) < F.size(windows),
            bind(bind(F.sort_array(places), same), total),
        ).otherwise(0)

    def windowed(hashes: Column) -> Column:
        following = F.transform(hashes, lambda h, i: F.xxhash64(h, *(F.get(hashes, i + k) for k in range(1, WINDOW))))
        return bind(F.slice(following, 1, F.size(hashes) - (WINDOW - 1)), covered)

    counted = bind(F.transform(tokens, lambda w: F.xxhash64(w)), windowed)
    return F.when(F.size(tokens) >= WINDOW, counted).otherwise(0).cast("long")


def statistics(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The columns ``carry``, the base columns and the vector __x0 to __x5, from one reading of each text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    first = docs.select(
        *carry,
        words(text).alias("__words"),
        lines.alias("__lines"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).alias("__upper"),
    )
    counted = first.select(
        *carry,
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("__words")).alias("n_repeat_words"),
        "__upper",
        F.size("__lines").alias("__n_lines"),
        F.size(F.array_distinct("__words")).alias("__distinct"),
    )
    n = F.greatest(F.col("n_words"), F.lit(1))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    vector = [
        F.ln((F.col("word_chars") + 5 * PRIOR_WORDS) / (n + PRIOR_WORDS)),
        F.log1p(10 * F.col("n_symbols") / (n + PRIOR_WORDS / 4)),
        F.sqrt(F.col("n_dup_lines") / (F.col("__n_lines") + PRIOR_LINES)),
        F.sqrt(F.col("n_repeat_words") / n),
        F.sqrt(F.col("__upper") / F.greatest(F.col("word_chars"), F.lit(1))),
        F.ln((F.col("__distinct") + 1.0) / (F.pow(n, 0.85) + 1)),
    ]
    return counted.select(
        *carry,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        *(v.cast("double").alias(f"__x{k}") for k, v in enumerate(vector)),
    )


_X = [f"__x{k}" for k in range(DIMENSIONS)]
_KEY = ["__lang", "__source"]
_PAIRS = [(i, j) for i in range(DIMENSIONS) for j in range(i + 1)]
_MEANS = [f"m{k}" for k in range(DIMENSIONS)]
_COVARIANCES = [f"c_{i}_{j}" for i, j in _PAIRS]
_PRECISIONS = [f"p_{i}_{j}" for i, j in _PAIRS]


def _attach(vectors: DataFrame, groups: DataFrame, few: bool) -> DataFrame:
    keyed = groups.withColumnsRenamed({c: c.replace("__", "k_") for c in _KEY})
    on = vectors["__lang"].eqNullSafe(keyed["k_lang"]) & vectors["__source"].eqNullSafe(keyed["k_source"])
    return vectors.join(F.broadcast(keyed) if few else keyed, on).drop("k_lang", "k_source")


def _middle(value: Column, share: float = 0.5) -> Column:
    return F.percentile_approx(value, share, 2000)


def _with_precision(moments: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep``, means, covariances c_ij (i >= j), the precision matrix p_ij of covariances with floors, and
    their log determinant, by Cholesky's factor L and its inverse W: the precision is W'W."""
    d = DIMENSIONS
    out = moments
    for i in range(d):
        for j in range(i + 1):
            rest = F.col(f"c_{i}_{j}") + (F.lit(FLOORS[i] ** 2) if i == j else F.lit(0.0))
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            out = out.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l_{j}_{j}"))
    for j in range(d):
        for i in range(j, d):
            if i == j:
                value = 1 / F.col(f"l_{i}_{i}")
            else:
                value = -sum((F.col(f"l_{i}_{k}") * F.col(f"w_{k}_{j}") for k in range(j, i)), F.lit(0.0)) / F.col(f"l_{i}_{i}")
            out = out.withColumn(f"w_{i}_{j}", value)
    precision = [
        sum((F.col(f"w_{k}_{i}") * F.col(f"w_{k}_{j}") for k in range(i, d)), F.lit(0.0)).alias(f"p_{i}_{j}") for i, j in _PAIRS
    ]
    log_det = sum((2 * F.ln(f"l_{i}_{i}") for i in range(d)), F.lit(0.0))
    return out.select(*keep, *_MEANS, *_COVARIANCES, *precision, log_det.alias("log_det"))


def _distance(m, p) -> Column:
    """Squared Mahalanobis distance of the vector from means m(k) with precision p(i, j)."""
    z = [F.col(x) - m(k) for k, x in enumerate(_X)]
    return sum((z[i] * z[j] * p(i, j) * (1 if i == j else 2) for i, j in _PAIRS), F.lit(0.0))


def _starts(vectors: DataFrame, few: bool) -> DataFrame:
    """Three estimates a group: lang, source, start, n, means and covariances."""
    d = range(DIMENSIONS)
    medians = vectors.groupBy(*_KEY).agg(
        F.count("*").alias("n"),
        *(_middle(F.col(x)).alias(f"q{k}") for k, x in enumerate(_X)),
        *(F.avg(x).alias(f"a{k}") for k, x in enumerate(_X)),
        *(F.covar_pop(_X[i], _X[j]).alias(f"v_{i}_{j}") for i, j in _PAIRS),
    )
    medians = materialise(medians, "groups")
    spread = _attach(vectors, medians.select(*_KEY, *(f"q{k}" for k in d)), few).groupBy(*_KEY).agg(
        *(_middle(F.abs(F.col(x) - F.col(f"q{k}"))).alias(f"s{k}") for k, x in enumerate(_X))
    )
    held = materialise(_attach(medians, spread, few), "groups")
    # Deviations with floors, so that a statistic in which most agree doesn't swamp the others.
    wide = [F.sqrt(F.pow(1.4826 * F.col(f"s{k}"), 2) + FLOORS[k] ** 2) for k in d]
    scaled = _attach(vectors, held.select(*_KEY, *(f"q{k}" for k in d), *(w.alias(f"s{k}") for k, w in enumerate(wide))), few)
    scaled = scaled.select(*_KEY, *((F.col(x) - F.col(f"q{k}")).alias(f"z{k}") for k, x in enumerate(_X)), *(f"s{k}" for k in d))
    norm = sum((F.pow(F.col(f"z{k}") / F.col(f"s{k}"), 2) for k in d), F.lit(0.0))
    signs = scaled.withColumn("norm", F.greatest(norm, F.lit(1e-12))).groupBy(*_KEY).agg(
        *(F.avg(DIMENSIONS * F.col(f"z{i}") * F.col(f"z{j}") / F.col("norm")).alias(f"g_{i}_{j}") for i, j in _PAIRS)
    )
    held = materialise(_attach(held, signs, few), "groups")
    kinds = [
        ("q", lambda i, j: F.pow(1.4826 * F.col(f"s{i}"), 2) if i == j else F.lit(0.0)),
        ("a", lambda i, j: F.col(f"v_{i}_{j}")),
        ("q", lambda i, j: F.col(f"g_{i}_{j}")),
    ]
    each = [
        F.struct(F.lit(number).alias("start"), *(F.col(f"{centre}{k}").alias(f"m{k}") for k in d), *(matrix(i, j).alias(f"c_{i}_{j}") for i, j in _PAIRS))
        for number, (centre, matrix) in enumerate(kinds)
    ]
    return held.select(*_KEY, "n", F.inline(F.array(*each)))


def _concentrated(vectors: DataFrame, few: bool) -> DataFrame:
    """Of every group, the estimate of least determinant after concentration: lang, source, n, means and covariances."""
    own = [*_KEY, "start", "n"]
    groups = materialise(_with_precision(_starts(vectors, few), own), "groups")
    distance = _distance(lambda k: F.col(f"m{k}"), lambda i, j: F.col(f"p_{i}_{j}"))
    done, active = None, groups
    for step in range(STEPS):
        measured = _attach(vectors, active, few).select(*own, *_X, distance.alias("d2"))
        edges = materialise(measured.groupBy(*_KEY, "start").agg(_middle(F.col("d2"), SUBSET).alias("edge")), "groups")
        keyed = active.join(edges.withColumnsRenamed({c: c.replace("__", "e_") for c in _KEY} | {"start": "e_start"}),
                            F.col("__lang").eqNullSafe(F.col("e_lang")) & F.col("__source").eqNullSafe(F.col("e_source")) & (F.col("start") == F.col("e_start")))
        near = _attach(vectors, keyed.drop("e_lang", "e_source", "e_start"), few).select(*own, *_X, "log_det", "edge", distance.alias("d2")).where("d2 <= edge")
        moments = near.groupBy(*own).agg(
            F.first("log_det").alias("before"),
            *(F.avg(x).alias(f"m{k}") for k, x in enumerate(_X)),
            *((CONSISTENCY * F.covar_pop(_X[i], _X[j])).alias(f"c_{i}_{j}") for i, j in _PAIRS),
        )
        moved = materialise(_with_precision(moments, [*own, "before"]), "groups")
        # The starts' own matrices aren't of a subset, so their determinants say nothing yet.
        settled = (F.col("log_det") > F.col("before") - 1e-9) if step else F.lit(False)
        if step == STEPS - 1:
            settled = F.lit(True)
        ended = moved.where(settled).drop("before")
        done = ended if done is None else done.unionByName(ended)
        active = moved.where(~settled).drop("before")
        if active.isEmpty():
            break
    best = done.groupBy(*_KEY).agg(F.min_by(F.struct("n", *_MEANS, *_COVARIANCES), F.struct("log_det", "start")).alias("best"))
    return materialise(best.select(*_KEY, "best.*"), "groups")


def _pooled(groups: DataFrame, keys: list[str]) -> DataFrame:
    """Moments of the groups' kept vectors taken together."""
    n, d = F.col("n"), range(DIMENSIONS)
    of = F.sum(n)
    sums = groups.groupBy(*keys).agg(
        of.alias("n"),
        *((F.sum(n * F.col(f"m{k}")) / of).alias(f"m{k}") for k in d),
        *((F.sum(n * (F.col(f"c_{i}_{j}") + F.col(f"m{i}") * F.col(f"m{j}"))) / of).alias(f"u_{i}_{j}") for i, j in _PAIRS),
    )
    return sums.select(*keys, "n", *_MEANS, *((F.col(f"u_{i}_{j}") - F.col(f"m{i}") * F.col(f"m{j}")).alias(f"c_{i}_{j}") for i, j in _PAIRS))


def _leaning(groups: DataFrame, keys: list[str], wider) -> DataFrame:
    """``groups`` with means and covariances between their own, counted n times, and the wider ones, ``wider(name)``, ``LEAN`` times."""
    mixed = lambda c: ((F.col("n") * F.col(c) + LEAN * wider(c)) / (F.col("n") + LEAN)).alias(c)
    return groups.select(*keys, "n", *map(mixed, [*_MEANS, *_COVARIANCES]))


def fit(stats: DataFrame) -> DataFrame:
    """Estimates by level (0: language and source, 1: language, 2: all): lang, source, n, means and precision matrix.
    ``stats`` has lang, source and the vector."""
    distinct = stats.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), *_X).distinct()
    vectors = materialise(distinct, "vectors")
    few = vectors.select(*_KEY).distinct().limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    groups = _concentrated(vectors, few)
    # Languages and the whole: pooled from groups, a row each.
    everything = materialise(_pooled(groups, []).where("n is not null"), "groups")
    tongues = _pooled(groups, ["__lang"])
    whole = everything.first()
    tongues = _leaning(tongues, ["__lang"], lambda c: F.lit(None if whole is None else whole[c]).cast("double"))
    tongues = materialise(tongues, "groups")
    other = tongues.select(*(F.col(c).alias(f"o_{c}") for c in tongues.columns))
    placed = groups.join(F.broadcast(other) if few else other, F.col("__lang").eqNullSafe(F.col("o___lang")))
    leaned = _leaning(placed, _KEY, lambda c: F.col(f"o_{c}"))
    none = F.lit(None).cast("string")
    levels = [
        leaned.withColumn("__level", F.lit(0)),
        tongues.withColumns({"__source": none, "__level": F.lit(1)}),
        everything.withColumns({"__lang": none, "__source": none, "__level": F.lit(2)}),
    ]
    united = levels[0].unionByName(levels[1]).unionByName(levels[2])
    return materialise(_with_precision(united, ["__level", *_KEY, "n"]), "groups")


def judge(stats: DataFrame, groups: DataFrame) -> DataFrame:
    """``stats`` with distance2 and kept: false if the base rule fails or the vector is an outlier of its group.

    A language and source that the fit hasn't seen are judged by the language, or else by all.
    """
    names = [*_MEANS, *_PRECISIONS]
    few = groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    # The estimate for all is one row, and goes into the plan as constants.
    overall = groups.where("__level = 2").select(*names).first()
    values = [F.lit(None if overall is None else overall[n]).cast("double").alias(n) for n in names]
    out = stats.withColumn("__g2", F.struct(*values))
    for level in range(2):
        held = groups.where(F.col("__level") == level).select(
            F.col("__lang").alias(f"__lang{level}"), F.col("__source").alias(f"__source{level}"), F.struct(*names).alias(f"__g{level}")
        )
        on = F.col("lang").eqNullSafe(F.col(f"__lang{level}"))
        if level < 1:
            on = on & F.col("source").eqNullSafe(F.col(f"__source{level}"))
        out = out.join(F.broadcast(held) if few else held, on, "left").drop(f"__lang{level}", f"__source{level}")
    out = out.withColumn("__g", F.coalesce("__g0", "__g1", "__g2")).drop("__g0", "__g1", "__g2")
    d2 = _distance(lambda k: F.col(f"__g.m{k}"), lambda i, j: F.col(f"__g.p_{i}_{j}"))
    out = out.withColumn("distance2", d2)
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance2") <= CUT, F.lit(True))).drop("__g")


def apply_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the base columns, base_failed, kept and distance2 of every row."""
    stats = materialise(statistics(docs, ["doc_id", "lang", "source"]), "text-statistics")
    return judge(stats, fit(stats)).drop("lang", "source", *_X)
