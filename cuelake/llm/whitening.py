"""Whitening of embeddings by a one-sided Jacobi SVD.

Vectors are put on a grid (1/256), the distinct ones are centred exactly and compressed by a blockwise TSQR: every task folds its
rows, some thousands at a time, into one triangle R; triangles are stacked and factored again, 32 to a task, until one is left. R has
the centred table's singular values and right singular vectors. Plane rotations make R's columns orthogonal; their lengths are the
singular values and the accumulated rotations are the components. No product of the table with itself is formed, so small
deviations keep their digits.

No row count or row reaches one task: R and the sums are as large as the dimension (d x d and d), whatever the number of rows. The
distinct vectors are found with partial aggregation, so a vector that a third of all rows share is one row a task. The rotations run
in the driver, on d x d numbers.

Defined results: rows whose vector is null or holds null or non-finite entries are dropped; vectors shorter than the longest are
filled up with zeros (those that differ in length alone are distinct); entries beyond 64 bits on the grid are its ends; null ids and repeated rows are rows of their own; a table without rows, or with one distinct vector, has no
component and gives an empty result; components without variance (rank below ``components``) are left out; a deviation beyond 64 bits
is null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

COMPONENTS = 4
GRID = 256
#: Triangles that one task stacks.
FAN = 32
#: Rows of a block.
BLOCK = 4096
#: A singular value below this share of the largest counts as none.
NOTHING = 1e-13


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors with sums S a dimension; components (d x k) with their eigenvalues, and all eigenvalues' sum."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def on_grid(embeddings: DataFrame, *, grid: int = GRID) -> DataFrame:
    """vec_id and x, the entries' places on the grid, of the rows whose entries are all finite numbers."""
    entry = lambda c: c.cast("double")
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(entry(c)) < float("inf")))
    x = F.transform("embedding", lambda c: F.floor(entry(c) * grid).cast("long"))
    return embeddings.where(F.col("embedding").isNotNull() & finite).select("vec_id", x.alias("x"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of longs, filled up with zeros to ``dims`` entries."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == dims).all():
        return flat.reshape(len(column), dims)
    out = np.zeros((len(column), dims), np.int64)
    out[np.arange(dims) < lengths[:, None]] = flat
    return out


def blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part, matrix(part.column("x"), dims)


def triangle(rows: np.ndarray) -> np.ndarray:
    """R of the QR factors, square: short stacks are filled up with zero rows."""
    dims = rows.shape[1]
    if len(rows) < dims:
        rows = np.vstack([rows, np.zeros((dims - len(rows), dims))])
    return np.linalg.qr(rows, mode="r")


def tsqr(distinct: DataFrame, mean: np.ndarray) -> np.ndarray:
    """R of the centred rows."""
    dims = len(mean)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for _, x in blocks(batches, dims):
            rows = x - mean
            r = triangle(rows if r is None else np.vstack([r, rows]))
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()])], names=["r"])

    def stack(group: pd.DataFrame) -> pd.DataFrame:
        rows = np.vstack([np.frombuffer(r).reshape(dims, dims) for r in group["r"].sort_values()])
        return pd.DataFrame({"r": [triangle(rows).tobytes()]})

    parts = distinct.select("x").mapInArrow(fold, "r binary")
    tasks = parts.rdd.getNumPartitions()
    parts = parts.withColumn("at", F.spark_partition_id())
    while tasks > FAN:
        tasks = -(-tasks // FAN)
        # A round's key is its rows' place in the round before, so no task stacks more than FAN triangles.
        parts = parts.withColumn("to", F.floor(F.col("at") / FAN).cast("int"))
        parts = parts.groupBy("to").applyInPandas(
            lambda key, group: stack(group).assign(at=key[0]), "r binary, at int"
        )
    return np.frombuffer(stack(pd.DataFrame({"r": [row["r"] for row in parts.select("r").collect()]}))["r"][0]).reshape(dims, dims)


def one_sided_jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, falling, and right singular vectors as columns.

    Rotations act on disjoint pairs of columns at once: in a round-robin order every pair meets once a sweep. A sweep in which every
    pair was orthogonal to working precision ends it.
    """
    dims = r.shape[1]
    even = dims + dims % 2
    a = np.zeros((r.shape[0], even))
    a[:, :dims] = r
    v = np.eye(even)
    eps = np.finfo(float).eps
    ring = np.arange(even)
    for _ in range(sweeps):
        largest = 0.0
        for _ in range(max(1, even - 1)):
            p, q = ring[: even // 2], ring[even // 2 :][::-1]
            ap, aq = a[:, p], a[:, q]
            alpha, beta, gamma = (ap * ap).sum(0), (aq * aq).sum(0), (ap * aq).sum(0)
            size = np.sqrt(alpha) * np.sqrt(beta)
            turn = np.abs(gamma) > eps * size
            if turn.any():
                largest = max(largest, (np.abs(gamma[turn]) / size[turn]).max())
                p, q, ap, aq = p[turn], q[turn], ap[:, turn], aq[:, turn]
                zeta = (beta[turn] - alpha[turn]) / (2 * gamma[turn])
                t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.hypot(1.0, t)
                s = c * t
                a[:, p], a[:, q] = c * ap - s * aq, s * ap + c * aq
                vp, vq = v[:, p], v[:, q]
                v[:, p], v[:, q] = c * vp - s * vq, s * vp + c * vq
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
        if largest <= 8 * eps:
            break
    lengths = np.sqrt((a * a).sum(0))[:dims]
    order = np.argsort(-lengths, kind="stable")
    return lengths[order], v[:dims, :dims][:, order]


def fit(distinct: DataFrame, *, components: int = COMPONENTS) -> Whitening:
    """Components of the distinct vectors ``x``, a row each."""
    dims = distinct.agg(F.max(F.size("x"))).first()[0] or 0

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for _, x in blocks(batches, dims):
            n += len(x)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([n] * dims), pa.array(range(dims)), pa.array(high), pa.array(low)], names=["n", "at", "high", "low"])

    if not dims:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0)
    parts = distinct.select("x").mapInArrow(add, "n long, at long, high long, low long")
    whole = F.sum(F.col("high").cast("decimal(38,0)") * 4294967296 + F.col("low")).alias("s")
    totals = parts.groupBy("at").agg(F.sum("n").alias("n"), whole).orderBy("at").collect()
    n, sums = totals[0]["n"], [int(row["s"]) for row in totals]
    lengths, vectors = one_sided_jacobi(tsqr(distinct, np.array([s / n for s in sums])))
    values = lengths * lengths / n
    some = int((lengths > NOTHING * lengths[0]).sum()) if lengths[0] > 0 else 0
    k = min(components, some)
    return Whitening(n, sums, vectors[:, :k], values[:k], float(values.sum()))


def whiten_block(x: np.ndarray, model: Whitening) -> np.ndarray:
    return (x - model.mean) @ (model.components / np.sqrt(model.eigenvalues))


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened distinct vectors' covariance less the identity."""
    k = len(model.eigenvalues)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(k + k * k)
        for _, x in blocks(batches, len(model.sums)):
            z = whiten_block(x, model)
            sums += np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([sums.tolist()])], names=["sums"])

    parts = distinct.select("x").mapInArrow(moments, "sums array<double>")
    found = parts.select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("s")).orderBy("pos").collect()
    s = np.array([row["s"] for row in found]) / model.n
    # z is centred already, but for rounding, which the mean takes off.
    return float(np.abs(s[k:].reshape(k, k) - np.outer(s[:k], s[:k]) - np.eye(k)).max())


def deviations(x: np.ndarray, model: Whitening) -> np.ndarray | list[int | None]:
    """Sums of (n x - S) squared, exact; null where 64 bits don't hold them."""
    most = max(int(x.max()), -int(x.min())) * model.n + max(map(abs, model.sums))
    if most * most * x.shape[1] < 1 << 63:
        d = x * model.n - np.array(model.sums)
        return (d * d).sum(axis=1)
    exact = [sum((model.n * int(c) - s) ** 2 for c, s in zip(row, model.sums)) for row in x]
    return [v if v < 1 << 63 else None for v in exact]


def whiten(embeddings: DataFrame, *, components: int = COMPONENTS, grid: int = GRID) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error: a row for each vector and component."""
    rows = on_grid(embeddings, grid=grid)
    distinct = materialise(rows.select("x").distinct(), "whitening-distinct")
    model = fit(distinct, components=components)
    k = len(model.eigenvalues)
    error = identity_error(distinct, model) if k else 0.0
    ids = rows.schema["vec_id"].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in blocks(batches, len(model.sums)):
            z, m = whiten_block(x, model), len(x)
            columns = {
                "vec_id": part.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))),
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                "n": pa.array(np.full(m * k, model.n)),
                "deviation": pa.array(deviations(x, model), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                "whitened": pa.array(z.ravel()),
                "explained": pa.array(np.tile(model.eigenvalues / model.trace, m)),
                "identity_error": pa.array(np.full(m * k, error)),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = f"vec_id {ids}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not k:
        return embeddings.sparkSession.createDataFrame([], schema)
    return rows.mapInArrow(apply, schema)
