"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A text is the sequence of its k-mers of ``K`` words (A-Z lowered; characters outside letters and
digits part words), each labelled with how often it has occurred before, so that none repeats.
A sketch is made of the ``PICKED`` k-mers of least hash, kept in the order of the text; equal
sketches therefore need the same k-mers in the same order, which makes them sensitive to edit
similarity. Every text has ``SKETCHES`` of them; texts that share one are candidates.

A candidate pair is verified by aligning the two word sequences within a band around the diagonal:
with m words aligned, the similarity is m / max(n1, n2), the share of the longer text that stands in the
other one in the same order. Pairs of ``SIMILARITY`` or more are linked. Classes are the connected
components of links and exact copies.

Skew. Exact copies are first merged by their digest (partial aggregates, whatever their number).
Within a group of equal sketches every text is compared with the first and the last of the group,
not with all others. Once components are known, what is left are the pairs of a group that are in different
components. Most texts of a crowded group are in one component by then, and these need no comparison among
each other: the others are compared with each other and with these, in blocks of about ``BLOCK`` x ``BLOCK``
texts, which make their pairs themselves. A block links on as it goes, so texts that have met aren't aligned
again, and aligns only pairs that have enough words in common whatever their order (counts of words in 256
buckets, an upper bound). So every pair that shares a sketch ends up in one component or verified; nothing is
capped. That step's comparisons still grow with the product of a group's main component and the rest.

No join or window needs the rows of a group, component or text in one task: what is one row a key
(ends of groups, roots of roots, classes) is written before the many rows are joined to it, so that
Spark can split a key with many of them.

Two texts whose k-mers have Jaccard similarity J share a sketch with probability 1 - (1 - J**PICKED)**SKETCHES or
somewhat more: above 0.998 for J = 0.5, where some 7 % of the words are changed one by one, and 0.62 for
J = 0.2, 20 % changed one by one; edits that stand together break fewer k-mers.

Defined results: null texts are in classes of their own; equal texts, empty ones too, are copies
of each other; texts without words but for that never resemble each other; texts of fewer than K
words are a single k-mer, so resemble only texts of the same words; repeated rows (same id, same
text) are copies; a similarity of exactly ``SIMILARITY`` links; an empty table gives an empty result; other
columns are ignored. In alignments a word is the low 16 bits of its hash.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORDS, materialise, slices, texts_as_bytes

K = 5
PICKED = 2
SKETCHES = 24
SIMILARITY = 0.8
BLOCK = 500
BLOCK_BYTES = 32 << 20
#: Buckets of the word counts that bound what two texts have in common.
BUCKETS = 256
#: Words of a text that are aligned between two looks at whether the similarity is still within reach.
ROWS = 512

_MIX = np.random.default_rng(10).integers(1, 1 << 63, (SKETCHES, 2), dtype=np.uint64) | np.uint64(1)


def word_numbers(text: bytes) -> np.ndarray:
    """A number for each word. Their low 16 bits do for verification."""
    words = text.translate(WORDS).split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def kmers(numbers: np.ndarray) -> np.ndarray:
    """Hashes of the occurrence-labelled k-mers of a sequence of word numbers, in order."""
    if not len(numbers):
        return numbers
    size = min(K, len(numbers))
    n = len(numbers) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = (out ^ numbers[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    # Occurrence labels: the place among equal values, in order.
    order = np.argsort(out, kind="stable")
    ranked = out[order]
    first = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    if not first.all():
        begins = np.flatnonzero(first)
        label = np.empty(n, np.uint64)
        label[order] = np.arange(n) - np.repeat(begins, np.diff(np.append(begins, n)))
        out = (out + label) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out


def sketches(seq: np.ndarray) -> np.ndarray:
    """One key for every sketch: a digest of its least k-mers in the order of the text."""
    if not len(seq):
        return np.zeros(0, np.int64)
    picked = min(PICKED, len(seq))
    hashes = (seq ^ _MIX[:, :1]) * _MIX[:, 1:]
    hashes ^= hashes >> np.uint64(32)
    if picked < len(seq):
        chosen = np.argpartition(hashes, picked - 1, axis=1)[:, :picked]
        chosen.sort(axis=1)
        kept = seq[chosen]
    else:
        kept = np.broadcast_to(seq, (SKETCHES, picked))
    keys = np.full(SKETCHES, picked, np.uint64)
    for k in range(picked):
        keys = (keys ^ kept[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def _places(window: np.ndarray, wanted: set[int]) -> dict[int, int]:
    """For each wanted word the places where it stands in the window, as bits of a number."""
    if len(window) <= 4096:
        bits: dict[int, int] = defaultdict(int)
        for place, word in enumerate(window.tolist()):
            if word in wanted:
                bits[word] |= 1 << place
        return bits
    at: dict[int, list[int]] = defaultdict(list)
    for place in np.flatnonzero(np.isin(window, np.fromiter(wanted, window.dtype, len(wanted)))).tolist():
        at[int(window[place])].append(place)
    flags, out = np.zeros(len(window), np.uint8), {}
    for word, places in at.items():
        flags[places] = 1
        out[word] = int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")
        flags[places] = 0
    return out


def aligned(one: np.ndarray, other: np.ndarray, need: float, band: int) -> int:
    """The length of the longest common subsequence whose places differ by ``band`` at most; less where ``need`` is out of reach.

    A row of the alignment's table is one number whose zero bits are the places where the length rises; a row follows from the one
    before by an addition. Of each stretch of ``ROWS`` rows, only the columns of the band take part.
    """
    n, m = len(one), len(other)
    rises = (1 << n) - 1
    for at in range(0, m, ROWS):
        rows = other[at : at + ROWS].tolist()
        low, high = max(0, at - band), min(n, at + len(rows) + band)
        if low >= high:
            break
        bits, full = _places(one[low:high], set(rows)), (1 << (high - low)) - 1
        row = (rises >> low) & full
        for word in rows:
            if found := bits.get(word):
                met = row & found
                row = ((row + met) | (row - met)) & full
        rises = (rises & ~(full << low)) | (row << low)
        if n - rises.bit_count() + m - at - len(rows) < need:
            break
    return n - rises.bit_count()


def similarity(one: np.ndarray, other: np.ndarray, least: float = SIMILARITY) -> float:
    """Share of the longer word sequence that is aligned with the other; 0 where it cannot reach ``least``."""
    longer = max(len(one), len(other))
    shorter = min(len(one), len(other))
    # Thresholds are met by equality, whatever the rounding of the product.
    need = least * longer - 1e-6
    if not shorter or shorter < need:
        return 0.0
    # An alignment of m pairs passes over n1 - m and n2 - m places: no pair is further off the diagonal.
    band = int(longer - need)
    same = one[:shorter] == other[:shorter]
    head = shorter if same.all() else int(np.argmin(same))
    same = one[len(one) - shorter + head :][::-1] == other[len(other) - shorter + head :][::-1]
    tail = len(same) if same.all() else int(np.argmin(same))
    m = head + tail
    m += aligned(one[head : len(one) - tail], other[head : len(other) - tail], need - m, band)
    return m / longer if m >= need else 0.0


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        keys = [sketches(kmers(word_numbers(t))) for t in texts_as_bytes(batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("node"), pa.array(keys, pa.list_(pa.int64()))],
            names=["doc_id", "node", "keys"],
        )


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        words = [word_numbers(t).astype(np.uint16).tobytes() for t in texts_as_bytes(batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("node"), pa.array(words, pa.binary())], names=["doc_id", "node", "seq"]
        )


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ones, others = (batch.column(c).to_pylist() for c in ("seq_a", "seq_b"))
            found = [similarity(np.frombuffer(a, np.uint16), np.frombuffer(b, np.uint16), least) for a, b in zip(ones, others, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(found, pa.float64())], names=["a", "b", "similarity"]
            )

    return run


def _verified(pairs: DataFrame, seqs: DataFrame, least: float) -> DataFrame:
    """Of pairs (a < b) those whose alignment reaches ``least``."""
    one = seqs.select(F.col("node").alias("a"), F.col("seq").alias("seq_a"))
    other = seqs.select(F.col("node").alias("b"), F.col("seq").alias("seq_b"))
    both = pairs.join(one, "a").join(other, "b").select("a", "b", "seq_a", "seq_b")
    return both.mapInArrow(_verify(least), "a binary, b binary, similarity double").where("similarity > 0")


def components(links: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node that has a link (a, b).

    Each round gives every node the least root among its own and its neighbours', then follows
    roots of roots; the number of rounds grows with the logarithm of the longest chain.
    """
    links = links.select("a", "b")
    both = materialise(links.union(links.select("b", "a")).toDF("node", "near"), "links")
    roots = both.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("root"))
    roots = materialise(roots, "roots")
    while True:
        seen = both.join(roots.select(F.col("node").alias("near"), F.col("root").alias("r")), "near")
        least = seen.groupBy("node").agg(F.min("r").alias("r"))
        # What a node has learned is also told to its old root.
        moved = roots.join(least, "node").select("node", "root", F.least("root", "r").alias("new"))
        moved = materialise(moved, "roots")
        told = (
            moved.select(F.col("root").alias("node"), "new")
            .union(moved.select("node", "new"))
            .groupBy("node")
            .agg(F.min("new").alias("to"))
        )
        told = materialise(told, "roots")
        jumped = told.join(told.select(F.col("node").alias("to"), F.col("to").alias("far")), "to", "left")
        following = materialise(jumped.select("node", F.least("to", F.coalesce("far", "to")).alias("root")), "roots")
        changed = following.join(roots.withColumnRenamed("root", "old"), "node").where("root <> old").limit(1)
        roots = following
        if changed.isEmpty():
            return roots


def _pairs(one, other) -> tuple:
    return F.least(one, other).alias("a"), F.greatest(one, other).alias("b")


def _first_pairs(members: DataFrame) -> DataFrame:
    """Every member of a group with the group's first and last."""
    ends = members.groupBy("band", "key").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first <> last")
    ends = materialise(ends, "group-ends")
    joined = members.join(ends, ["band", "key"])
    to_first = joined.where("node <> first").select(*_pairs(F.col("node"), F.col("first")))
    to_last = joined.where("node <> last and node <> first").select(*_pairs(F.col("node"), F.col("last")))
    return to_first.union(to_last).distinct()


def _compare_block(least: float):
    """applyInPandas over a block (i, j) of a group: links between texts of part i and texts of part j.

    Pairs that links of the block connect already aren't aligned any more.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node", ignore_index=True)
        i, j, band = int(rows["i"][0]), int(rows["j"][0]), int(rows["band"][0])
        part = rows["part"].to_numpy()
        _, root = np.unique(rows["root"].to_numpy(), return_inverse=True)
        keys = np.array(rows["keys"].tolist(), np.int64)[:, :band]
        seqs = [np.frombuffer(x, np.uint16) for x in rows["seq"]]
        size = np.array([len(x) for x in seqs])
        counts = np.stack([np.bincount(x % BUCKETS, minlength=BUCKETS) for x in seqs]).astype(np.int32)
        links = []
        for a in np.flatnonzero(part == i).tolist():
            others = part == j
            if i == j:
                others[: a + 1] = False
            need = least * np.maximum(size[a], size) - 1e-6
            others &= (root != root[a]) & (np.minimum(size[a], size) >= need)
            near = np.flatnonzero(others)
            # A pair is compared in the first group that holds both.
            near = near[~(keys[near] == keys[a]).any(axis=1)]
            near = near[np.minimum(counts[near], counts[a]).sum(axis=1) >= need[near]]
            for b in near.tolist():
                if root[b] != root[a] and (found := similarity(seqs[a], seqs[b], least)) > 0:
                    links.append((*sorted((rows["node"][a], rows["node"][b])), found))
                    root[root == root[b]] = root[a]
        return pd.DataFrame(links, columns=["a", "b", "similarity"])

    return run


def _rest_links(members: DataFrame, roots: DataFrame, nodes: DataFrame, seqs: DataFrame, least: float) -> DataFrame:
    """Links that join what is connected among the texts of a group that are in different components.

    The texts of a group's largest component are the main ones; all others are compared with each other and with the main ones.
    Parts are of some ``BLOCK`` texts and ``BLOCK_BYTES`` at most on average. Other texts are dealt to blocks (i, j), i <= j, of their
    parts and to blocks (i, main j); a main text to one block for each part of the others, which are few where the main ones are many.
    """
    group = ["band", "key"]
    sizes = seqs.select("node", F.octet_length("seq").cast("long").alias("bytes"))
    placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = materialise(placed.join(sizes, "node"), "groups")
    parts = placed.groupBy(*group, "root").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    parts = materialise(parts, "group-parts")
    whole = parts.groupBy(*group).agg(
        F.count("*").alias("of"), F.max(F.struct("n", "bytes", "root")).alias("main"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes")
    ).where("of > 1")
    many = lambda n, size: F.ceil(F.greatest(F.lit(1), n / BLOCK, size / BLOCK_BYTES)).cast("int")
    several = materialise(
        whole.select(
            *group,
            F.col("main.root").alias("main"),
            many(F.col("main.n"), F.col("main.bytes")).alias("mains"),
            many(F.col("n") - F.col("main.n"), F.col("bytes") - F.col("main.bytes")).alias("others"),
        ),
        "groups",
    )
    dealt = placed.join(several, group).withColumn("is_main", F.col("root") == F.col("main"))
    part = F.pmod(F.xxhash64("node"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others"))).cast("int")
    # Parts of the main component have negative numbers, from -1 down.
    dealt = dealt.withColumn("part", F.when(F.col("is_main"), -1 - part).otherwise(part))
    beside = F.sequence(F.lit(0), F.col("others") - 1)
    beside = F.when(F.col("is_main"), beside).otherwise(F.concat(beside, F.sequence(F.lit(-1), -F.col("mains"))))
    blocks = dealt.select(*group, "node", "root", "part", F.explode(beside).alias("other"))
    blocks = blocks.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")}).drop("other")
    blocks = blocks.join(seqs, "node").join(nodes.select("node", "keys"), "node")
    return blocks.groupBy(*group, "i", "j").applyInPandas(_compare_block(least), "a binary, b binary, similarity double").dropDuplicates(["a", "b"])


def near_duplicates(docs: DataFrame, *, least: float = SIMILARITY) -> DataFrame:
    """doc_id, text_md5 (binary; null for a null text), class_id (the least id of the class), class_texts
    (different texts in the class), n_links (verified links of the row's text, of the pairs that had to be
    compared: those within a class that is connected already are left out) and representative (the row to
    keep of the class) of every row.
    """
    rows = docs.select("doc_id", "text").withColumn("node", F.unhex(F.md5("text")))
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    known = rows.where("node is not null")
    sketched = materialise(known.mapInArrow(_sketch, f"doc_id {doc_type}, node binary, keys array<long>"), "sketches")
    nodes = sketched.groupBy("node").agg(F.min("doc_id").alias("least_id"), F.first("keys").alias("keys"))
    nodes = materialise(nodes, "nodes")
    members = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    # Groups of one are most of them and go at once.
    shared = members.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    shared = materialise(shared, "sketch-groups")
    members = materialise(members.join(shared, ["band", "key"]), "sketch-groups")

    # Word sequences of the texts in groups, one row for each.
    wanted = members.select("node").distinct().join(nodes.select("node", "least_id"), "node")
    seqs = known.mapInArrow(_words, f"doc_id {doc_type}, node binary, seq binary")
    seqs = seqs.join(
        wanted.withColumnRenamed("node", "n"), (F.col("node") == F.col("n")) & F.col("doc_id").eqNullSafe(F.col("least_id"))
    )
    seqs = materialise(seqs.select("node", "seq").dropDuplicates(["node"]), "sequences")

    pairs = materialise(_first_pairs(members), "pairs")
    links = materialise(_verified(pairs, seqs, least), "verified")
    links = links.union(materialise(_rest_links(members, components(links), nodes, seqs, least), "verified"))
    roots = components(links)

    degree = links.select("a").union(links.select("b")).toDF("node").groupBy("node").agg(F.count("*").alias("n_links"))
    placed = nodes.select("node", "least_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = placed.groupBy("root").agg(
        F.min("least_id").alias("class_id"),
        F.count("*").alias("class_texts"),
        F.min(F.struct(F.col("least_id").isNull(), "least_id", "node"))["node"].alias("kept_node"),
    )
    classes = materialise(classes, "classes")
    placed = placed.join(classes, "root").join(degree, "node", "left")
    is_kept = F.col("node") == F.col("kept_node")
    placed = materialise(
        placed.select("node", "least_id", "class_id", "class_texts", "n_links", is_kept.alias("is_kept")), "classes"
    )
    # Null texts, which have no node, come from the input itself.
    every = sketched.select("doc_id", "node").union(rows.where("node is null").select("doc_id", "node"))
    return every.join(placed, "node", "left").select(
        "doc_id",
        F.col("node").alias("text_md5"),
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("class_texts", F.lit(1)).cast("long").alias("class_texts"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (F.col("node").isNull() | (F.col("is_kept") & F.col("doc_id").eqNullSafe(F.col("least_id")))).alias("representative"),
    )
