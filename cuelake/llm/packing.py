"""Packing along a space-filling curve.

Each document's token counts are hashed into a vector of ``WIDTH`` places and projected to three
dimensions. The place of that point on a Hilbert curve, with some bits of a row hash below it to
part equal points, is the sort key; documents near each other on the curve follow each other in
one stream of tokens, which is cut every ``SEQUENCE`` tokens.

Texts are tokenised once: ids go as two or four bytes each into a table in the shared folder, are
range-partitioned once by curve place, and become pieces there. Where a run starts in the stream
follows from the sums of token counts of the runs before it, so only those sums meet on the driver:
two numbers for every ``RUN_TOKENS`` tokens, and no more than ``CUT_SAMPLE`` runs, which at 25 T
tokens hold 25 million each. A hot group of equal texts is split by the row bits of the key.

Defined results: a null text is empty, and an empty one is its end id alone; the string of a
special token in a text is that token's id; repeated rows are documents of their own; an empty table gives an empty result; other columns are ignored. Only the
last sequence of all can be shorter than ``SEQUENCE``, so there is no other padding.
"""

from __future__ import annotations

import base64
import functools
import json
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices

SEQUENCE = 2048
END_ID = 1
WIDTH = 1024
DIMENSIONS = 3
BITS = 10
#: Bits of the row hash below the curve place; 30 + 20 bits are exact as a double.
TIE_BITS = 20
#: Tokens of a run, which one task sorts. Their number follows the data, so a run's size doesn't.
RUN_TOKENS = 4_000_000
#: Keys looked at for the cuts between runs. They set how even runs are, not what is in them.
CUT_SAMPLE = 1_000_000
SEED = 8


@functools.lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """The byte-level BPE of a ``.tiktoken`` ranks file, or of a ``.json`` tokenizer file.

    A ``.json`` file with a ``.tiktoken`` file of the same name beside it is read from the latter:
    the same vocabulary and ids, several times faster. The file's added tokens keep their own ids
    where their strings stand in a text, as in ``Tokenizer.from_file(...).encode(text, add_special_tokens=False)``.
    """
    import os

    ranks = vocabulary.removesuffix(".json") + ".tiktoken"
    added: dict[str, int] = {}
    if not vocabulary.endswith(".tiktoken"):
        with open(vocabulary, "rb") as file:
            marks = json.load(file).get("added_tokens", [])
        added = {m["content"]: m["id"] for m in marks}
        # The ranks' library knows only marks that stand as they are, without words or spaces around them.
        plain = not any(m.get(k) for m in marks for k in ("single_word", "lstrip", "rstrip", "normalized"))
        if not (plain and os.path.exists(ranks)):
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(vocabulary)
            return lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    import public_tokenizers
    import tiktoken

    with open(vocabulary if vocabulary.endswith(".tiktoken") else ranks, "rb") as lines:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens=added)
    return lambda text: encoding.encode(text, allowed_special="all") if any(m in text for m in added) else encoding.encode_ordinary(text)


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def _tokens(vocabulary: str, columns: list[str]):
    """mapInArrow: the columns, then ids (little-endian; two bytes each where all fit), n_tokens, x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        projection = np.random.default_rng(SEED).standard_normal((WIDTH, DIMENSIONS)).astype(np.float32)
        for batch in slices(batches, "text", 4 << 20):
            ids, counts, points = [], [], np.zeros((batch.num_rows, DIMENSIONS), np.float32)
            for row, text in enumerate(batch.column("text").to_pylist()):
                found = np.array([*encode(text or ""), END_ID], np.uint32)
                vector = np.sqrt(np.bincount(found[:-1] % WIDTH, minlength=WIDTH).astype(np.float32))
                points[row] = (vector / max(1.0, float(np.linalg.norm(vector)))) @ projection
                counts.append(len(found))
                ids.append((b"\x02" if found.max() < 65536 else b"\x04") + found.astype("<u2" if found.max() < 65536 else "<u4").tobytes())
            out = [pa.array(ids, pa.binary()), pa.array(counts, pa.int64()), *(pa.array(points[:, k], pa.float32()) for k in range(DIMENSIONS))]
            names = ["ids", "n_tokens", *(f"x{k}" for k in range(DIMENSIONS))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *out], names=[*columns, *names])

    return run


def hilbert_place(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points with integer coordinates (rows) of ``bits`` bits.

    The published transposition: undo excess work from the top bit down, Gray-code, interleave.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for shift in range(bits - 1, 0, -1):
        bit, below = 1 << shift, (1 << shift) - 1
        for k in range(n):
            is_set = (x[k] & bit) != 0
            swap = np.where(is_set, 0, (x[0] ^ x[k]) & below)
            x[0] ^= np.where(is_set, below, swap)
            x[k] ^= swap
    for k in range(1, n):
        x[k] ^= x[k - 1]
    fix = np.zeros_like(x[0])
    for shift in range(bits - 1, 0, -1):
        fix ^= np.where(x[n - 1] & (1 << shift), (1 << shift) - 1, 0)
    x ^= fix
    place = np.zeros_like(x[0])
    for shift in range(bits - 1, -1, -1):
        for k in range(n):
            place = (place << 1) | ((x[k] >> shift) & 1)
    return place


def _curve_key(means: list[float], deviations: list[float]):
    @F.pandas_udf("long")
    def key(x0: pd.Series, x1: pd.Series, x2: pd.Series, tie: pd.Series) -> pd.Series:
        points = np.stack([x0, x1, x2], axis=1).astype(np.float64)
        # A logistic curve in place of the normal one spreads the points over the cells.
        even = 1 / (1 + np.exp(-1.702 * (points - means) / deviations))
        cells = np.clip((even * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
        return pd.Series((hilbert_place(cells, BITS) << TIE_BITS) | tie.to_numpy())

    return key


def _pieces(starts, sequence: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        current, at = None, 0
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for doc, ids, n, run_id in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "n_tokens", "run")), strict=True):
                if run_id != current:
                    current, at = run_id, starts.value[run_id]
                wide = np.frombuffer(ids, "<u2" if ids[0] == 2 else "<u4", offset=1).astype("<u4")
                begin = 0
                while begin < n:
                    offset = at % sequence
                    length = min(n - begin, sequence - offset)
                    crc = zlib.crc32(wide[begin : begin + length].tobytes())
                    for column, value in zip(rows, (doc, begin, length, crc, n, at // sequence, offset), strict=True):
                        column.append(value)
                    begin += length
                    at += length
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[0], batch.column("doc_id").type), *(pa.array(c, pa.int64()) for c in rows[1:])], names=names
            )

    return run


def pack(
    docs: DataFrame, *, vocabulary: str | None = None, sequence: int = SEQUENCE, run_tokens: int = RUN_TOKENS
) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    points = ", ".join(f"x{k} float" for k in range(DIMENSIONS))
    # The row's number parts even rows that are equal in all columns. It is stored, so every later step sees the same.
    tie = F.xxhash64("doc_id", F.monotonically_increasing_id()).bitwiseAND((1 << TIE_BITS) - 1)
    tokens = docs.select("doc_id", tie.alias("tie"), "text").mapInArrow(
        _tokens(vocabulary or default_vocabulary(), ["doc_id", "tie"]),
        f"doc_id {doc_type}, tie long, ids binary, n_tokens long, {points}",
    )
    tokens = materialise(tokens, "tokens")

    axes = [f"x{k}" for k in range(DIMENSIONS)]
    total = tokens.agg(
        F.count("*"), F.sum("n_tokens"), *(f(c) for c in axes for f in (F.avg, F.stddev_pop))
    ).first()
    n_rows, n_tokens = total[0], total[1] or 0
    means = [v or 0.0 for v in total[2::2]]
    deviations = [max(v or 0.0, 1e-6) for v in total[3::2]]
    keyed = tokens.withColumn("key", _curve_key(means, deviations)(*axes, "tie"))

    runs = max(1, math.ceil(n_tokens / run_tokens))
    cuts: list[float] = []
    if runs > 1:
        # Long texts lie together on the curve, so runs are cut by tokens, not rows.
        some = keyed.select("key", "n_tokens").sample(min(1.0, CUT_SAMPLE / n_rows), seed=SEED)
        seen = some.toPandas().sort_values("key")
        if len(seen):
            tokens_to = seen["n_tokens"].cumsum().to_numpy()
            places = np.searchsorted(tokens_to, np.arange(1, runs) * (tokens_to[-1] / runs))
            cuts = np.unique(seen["key"].to_numpy()[places]).astype(float).tolist()
    # Keys aren't negative; the first bucket is there as a Bucketizer wants two at least.
    ranges = Bucketizer(splits=[-math.inf, -1.0, *cuts, math.inf], inputCol="place", outputCol="run_d")
    keyed = ranges.transform(keyed.withColumn("place", F.col("key").cast("double")))
    keyed = keyed.select("doc_id", "ids", "n_tokens", "key", (F.col("run_d").cast("int") - 1).alias("run"))

    sums = dict(keyed.groupBy("run").agg(F.sum("n_tokens")).collect())
    starts, at = {}, 0
    for run in sorted(sums):
        starts[run] = at
        at += sums[run]
    starts = spark.sparkContext.broadcast(starts)
    return (
        keyed.repartitionById(len(cuts) + 1, F.col("run"))
        .sortWithinPartitions("run", "key", "doc_id", "n_tokens")
        .mapInArrow(
            _pieces(starts, sequence),
            f"doc_id {doc_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
        )
    )
