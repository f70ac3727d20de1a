"""Quality classification by positive-unlabelled learning.

A logistic model on statistics of the text is trained to minimise the non-negative unbiased risk:
trusted positives stand for the good class, unlabelled texts for the mixture, and the class prior
ties the two, so no negative labels are needed. The prior is estimated
first: a fit on one half tells positives from unlabelled texts; on the other half, the share of
unlabelled texts that score like positives (above nearly all positives' lower end), over the same
share of the positives, is the prior. Negative labels are never used.

Fitting takes at most ``sample_docs`` positives and as many unlabelled texts, picked by a hash of
the row: a bound, not a share. Their statistics (not the texts) reach the driver, some
``sample_docs`` x ``FEATURES`` numbers. Scoring is one pass over every whole text, no shuffle.

Defined results: a null text is empty; every row gets a score in [0, 1], empty texts too; equal
texts get equal scores; without positives or unlabelled texts every score is 0.5; other columns
are ignored. An id with several labels is trusted as positive if all of them are 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import LOWER, slices, texts_as_bytes

SAMPLE_DOCS = 20_000
THRESHOLD = 0.7
STEPS = 600

_CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "space": (32, 9, 11, 12, 13),
    "stop": b".,;:",
    "loud": b"!?",
    "mark": b"#*$%&|<>",
    "other": b"\"'()+-/=@[]\\^_`{}~",
    "high": range(128, 256),
}
FEATURES = 26


def features(text: bytes) -> list[float]:
    """Shares of kinds of bytes, and how words and lines repeat; every value is of order one."""
    size = max(1, len(text))
    histogram = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = [histogram[list(c)].sum() / size for c in _CLASSES.values()]
    words = text.translate(LOWER).split()
    n = max(1, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    n_lines = max(1, len(lines))
    distinct = len(set(words)) / n
    pairs = len(set(zip(words, words[1:], strict=False))) / max(1, len(words) - 1)
    fives = len({tuple(words[k : k + 5]) for k in range(0, len(words) - 4)}) / max(1, len(words) - 4)
    same = sum(map(bytes.__eq__, words, words[1:])) / n
    letters = max(1e-9, shares[0] + shares[1])
    expected = min(1.0, n / (1 + n**0.75))
    return [
        *(np.sqrt(s) for s in shares),
        shares[0] / letters,
        min(3.0, sum(map(len, words)) / n / 5),
        np.log1p(n) / 8,
        np.log1p(n_lines) / 4,
        np.sqrt(1 - len(set(lines)) / n_lines) if lines else 0.0,
        distinct,
        distinct - (1 - expected),
        np.sqrt(1 - pairs) if len(words) > 1 else 0.0,
        np.sqrt(1 - fives) if len(words) > 4 else 0.0,
        np.sqrt(same),
        min(1.0, histogram[124] / n),
        min(1.0, (histogram[33] + histogram[63]) / n),
        min(1.0, sum(histogram[list(b"#*$%&")]) / n),
        min(1.0, sum(histogram[list(b".,")]) / n),
        1.0 if n < 20 else 0.0,
        1.0 if not words else 0.0,
        min(3.0, n / n_lines / 40),
    ]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        rows = [features(t) for t in texts_as_bytes(batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("positive"), pa.array(rows, pa.list_(pa.float64()))], names=["positive", "x"]
        )


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _fit_risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, steps: int) -> np.ndarray:
    """Weights (bias last) under the non-negative unbiased risk with logistic loss; without a prior,
    those that tell positives from unlabelled texts. Adam on the full sample, so always the same."""
    w = np.zeros(positive.shape[1])
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        p, u = _logistic(positive @ w), _logistic(unlabelled @ w)
        # Gradients of mean losses: as if labelled 1 (1 - p) or 0 (p).
        p_good, p_bad = -(positive.T @ (1 - p)) / len(p), (positive.T @ p) / len(p)
        u_bad = (unlabelled.T @ u) / len(u)
        if prior is None:
            gradient = (p_good + u_bad) / 2
        else:
            bad_risk = -np.log1p(-np.minimum(u, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(p, 1 - 1e-12)).mean()
            # A risk below 0 is fitted too closely: that step goes the other way, for the negative part alone.
            gradient = prior * p_good + u_bad - prior * p_bad if bad_risk >= 0 else prior * p_bad - u_bad
        gradient = gradient + 1e-4 * np.append(w[:-1], 0)
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        w = w - 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w


class QualityModel:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, prior: float):
        self.mean, self.scale, self.weights, self.prior = mean, scale, weights, prior

    def inputs(self, rows: np.ndarray) -> np.ndarray:
        # Beyond six deviations a statistic says no more than at six.
        return np.hstack([np.clip((rows - self.mean) / self.scale, -6, 6), np.ones((len(rows), 1))])

    def score(self, rows: np.ndarray) -> np.ndarray:
        return _logistic(self.inputs(rows) @ self.weights)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, steps: int) -> float:
    """Share of positives among the unlabelled: g tells positives from unlabelled on one half; on the
    other half, the share of unlabelled texts above the floor of g is divided by that of positives.
    Where sampling takes that quotient beyond 1, all unlabelled texts look positive, and it is 1."""
    if min(len(positive), len(unlabelled)) < 2:
        return 0.5
    w = _fit_risk(positive[::2], unlabelled[::2], None, steps)
    p, u = _logistic(positive[1::2] @ w), _logistic(unlabelled[1::2] @ w)
    # Unlabelled positives score as trusted ones do, so few of them lie below the trusted ones' floor.
    floor = np.quantile(p, 0.02)
    return float(min(1.0, (u >= floor).mean() / max(1e-9, (p >= floor).mean())))


def fit(docs: DataFrame, labels: DataFrame, *, sample_docs: int = SAMPLE_DOCS, steps: int = STEPS) -> QualityModel:
    """Learn from the rows of ``docs``: positives are those whose labels say quality 1, unlabelled those without any."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        F.min("quality").alias("__quality")
    )
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("__h", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)))
    # Ids and hashes alone are joined, for the sizes; then texts of the picked rows alone are read.
    sizes = {
        r["kind"]: r["n"]
        for r in rows.select("doc_id")
        .join(marks, "doc_id", "left")
        .groupBy(F.coalesce(F.col("__quality"), F.lit(-1)).alias("kind"))
        .agg(F.count("*").alias("n"))
        .collect()
    }
    if not sizes.get(1) or not sizes.get(-1):
        return QualityModel(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES + 1), 0.5)
    limit = {kind: 1_000_003 * min(1.0, sample_docs / sizes[kind]) for kind in (1, -1)}
    picked = (
        rows.where(F.col("__h") < max(limit.values()))
        .join(marks, "doc_id", "left")
        .where(
            ((F.col("__quality") == 1) & (F.col("__h") < limit[1]))
            | (F.col("__quality").isNull() & (F.col("__h") < limit[-1]))
        )
        .select((F.col("__quality").isNotNull()).alias("positive"), "text")
    )
    seen = picked.mapInArrow(_statistics, "positive boolean, x array<double>").toPandas()
    seen["x"] = seen["x"].map(tuple)
    seen = seen.sort_values(["positive", "x"])
    x = np.array(seen["x"].tolist()).reshape(-1, FEATURES)
    is_positive = seen["positive"].to_numpy(dtype=bool)
    if is_positive.all() or not is_positive.any():
        return QualityModel(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES + 1), 0.5)
    mean, scale = x[is_positive].mean(axis=0), np.maximum(x[is_positive].std(axis=0), 0.02)
    model = QualityModel(mean, scale, np.zeros(FEATURES + 1), 0.5)
    inputs = model.inputs(x)
    positive, unlabelled = inputs[is_positive], inputs[~is_positive]
    model.prior = estimate_prior(positive, unlabelled, steps)
    model.weights = _fit_risk(positive, unlabelled, model.prior, steps)
    return model


def predict(docs: DataFrame, model: QualityModel, *, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (all, if not given) and __score of every row."""
    carry = docs.columns if carry is None else carry
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            found = [features(t) for t in texts_as_bytes(batch.column("__text"))]
            scores = held.value.score(np.array(found).reshape(-1, FEATURES))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(scores, pa.float64())], names=[*carry, "__score"])

    schema = StructType([*(docs.schema[c] for c in carry), StructField("__score", DoubleType())])
    return docs.select(*carry, F.col("text").alias("__text")).mapInArrow(run, schema)
