"""Language identification by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary. Each language has a probability for every
piece; a run of letters scores the sum, over all its segmentations into pieces, of the product of
piece probabilities, found by a forward pass. Probabilities come from expectation-maximisation on
the words of labelled texts. A text's language is the one under which its runs of letters are
likeliest; the score is the posterior of that language with equal priors.

Fitting takes at most ``sample_docs`` labelled texts a language, picked by a hash of the row:
a bound, not a share, so the fit costs the same at any size. Scoring is one pass over every whole
text with no shuffle. Words met before are looked up in a bounded table of each task.

Defined results: ``und`` and score 0 where the text is null or has no letter, or no language could
be learned; repeated rows and ties are each scored alone (equal likelihoods: the alphabetically
first language); runs of letters are of any length (long ones are summed in blocks, the forward state
carried over and rescaled); other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices

#: Labelled texts a language that a fit may use.
SAMPLE_DOCS = 1500
ROUNDS = 3
#: Letters up to which whole runs are summed at once; longer ones go by blocks of this many.
BLOCK = 64
#: Numbers in the tables of one forward pass: words of one length are taken so many at a time.
TABLE = 1 << 22
#: Words a task remembers; beyond that it starts afresh.
REMEMBERED = 400_000
#: The model, a table of pieces by languages, is held to this many languages.
MOST_LANGUAGES = 500
#: Expected count that every piece has to begin with.
PRIOR_COUNT = 0.1

RUNS = re.compile(r"[^\W\d_]+")


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def vocabulary_pieces(path: str) -> list[str]:
    """The lower-case pieces of letters of a sentencepiece model, word marks removed, in order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(k).replace("▁", "").lower() for k in range(model.get_piece_size())}
    return sorted(p for p in pieces if p.isalpha())


def letter_runs(text: str) -> list[str]:
    """Runs of letters of the lower-cased text."""
    return RUNS.findall(text.lower())


_BASE = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """Where the pieces of the vocabulary lie in words. Any other letter is the piece numbered last.

    Pieces are found by hash for many words at once: a polynomial hash of 64 bits, looked up in a
    table and, for the few whose places there are taken, in a second one.
    """

    BITS = 18

    def __init__(self, pieces: list[str]):
        self.size = len(pieces) + 1
        self.longest = max(map(len, pieces), default=1)
        hashes = [int(self._prefixes([p])[0, -1]) for p in pieces]
        rng = np.random.default_rng(1)
        while True:
            self.tables, left = [], dict(zip(hashes, range(len(pieces)), strict=True))
            for _ in range(2):
                factor = int(rng.integers(1, 1 << 62)) * 2 + 1
                keys, values, over = np.zeros(1 << self.BITS, np.uint64), np.full(1 << self.BITS, -1, np.int32), {}
                for h, k in left.items():
                    slot = (h * factor) % (1 << 64) >> (64 - self.BITS)
                    if values[slot] < 0:
                        keys[slot], values[slot] = h, k
                    else:
                        over[h] = k
                self.tables.append((np.uint64(factor), keys, values))
                left = over
            if not left:
                break

    @staticmethod
    def _prefixes(words: list[str]) -> np.ndarray:
        """Hashes (word, end) of all beginnings of words of one length."""
        size = len(words[0])
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), size).astype(np.uint64)
        out = np.zeros((len(words), size + 1), np.uint64)
        for k in range(size):
            out[:, k + 1] = out[:, k] * _BASE + letters[:, k] + np.uint64(1)
        return out

    def lattice(self, words: list[str]) -> np.ndarray:
        """Piece numbers by (end, length - 1, word) for words of one length; -1 where there is none."""
        size = len(words[0])
        prefixes = self._prefixes(words).T.copy()
        out = np.full((size + 1, self.longest, len(words)), -1, np.int32)
        power = np.ones(1, np.uint64)
        for length in range(1, min(self.longest, size) + 1):
            power = power * _BASE
            h = prefixes[length:] - prefixes[:-length] * power
            found = np.full(h.shape, -1, np.int32)
            for factor, keys, values in self.tables:
                slot = (h * factor) >> np.uint64(64 - self.BITS)
                found = np.where(keys[slot] == h, values[slot], found)
            if length == 1:
                found[found < 0] = self.size - 1
            out[length:, length - 1] = found
        return out


def same_length(words: list[str], width: int) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Words of one length at a time, with their places; ``width`` numbers are needed a letter."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
        if len(group) and sizes[group[0]]:
            most = max(1, TABLE // (width * min(BLOCK, int(sizes[group[0]]))))
            for at in range(0, len(group), most):
                some = group[at : at + most]
                yield some, [words[k] for k in some.tolist()]


def block_size(chances: np.ndarray) -> int:
    """Letters that are summed under one scale, ``BLOCK`` at most.

    Every letter is a piece of its own at least, so a letter more makes a sum smaller by the least chance at worst, and this many of them
    can't take it out of the range of numbers.
    """
    least = chances[chances > 0].min(initial=1.0)
    return max(1, min(BLOCK, int(280 / max(1e-9, -np.log10(least)))))


def forward(lattice: np.ndarray, chances: np.ndarray, alpha: np.ndarray, begin: int = 1) -> np.ndarray:
    """Sums over segmentations of all beginnings, ``alpha`` (end, word, language), filled from ``begin`` on.
    The last row of ``chances`` is zero."""
    ends, longest, n = lattice.shape
    for end in range(begin, ends):
        for length in range(1, min(longest, end) + 1):
            number = lattice[end, length - 1]
            # Long pieces are rare: most words have none at most places.
            there = np.flatnonzero(number >= 0)
            if len(there) * 2 > n:
                alpha[end] += alpha[end - length] * chances[number]
            elif len(there):
                alpha[end, there] += alpha[end - length, there] * chances[number[there]]
    return alpha


def _whole(lattice: np.ndarray, chances: np.ndarray) -> np.ndarray:
    ends, _, n = lattice.shape
    alpha = np.zeros((ends, n, chances.shape[1]))
    alpha[0] = 1
    return forward(lattice, chances, alpha)


def _blocks(word: str, pieces: Pieces, chances: np.ndarray) -> Iterator[tuple]:
    """For a long word, block by block: its lattice, the scaled sums of beginnings, and the log of their scale by language.

    A block starts with the ``longest`` places before it, as pieces may begin there. The last of them has the value 1, in every language.
    """
    lead, size, block = pieces.longest, len(word), block_size(chances)
    before, scale = np.zeros((1, 1, chances.shape[1])), np.zeros(chances.shape[1])
    before[0] = 1
    at = 0
    while at < size:
        held = before.shape[0] - 1
        end = min(size, at + block)
        lattice = pieces.lattice([word[at - held : end]])
        alpha = np.zeros((end - at + held + 1, 1, chances.shape[1]))
        alpha[: held + 1] = before
        forward(lattice, chances, alpha, held + 1)
        yield at, held, lattice, alpha, scale.copy()
        before = alpha[-min(lead, end) - 1 :]
        last = np.maximum(before[-1, 0], 1e-300)
        before, scale, at = before / last, scale + np.log(last), end


def word_scores(words: list[str], pieces: Pieces, chances: np.ndarray) -> np.ndarray:
    """Log probabilities (word, language)."""
    out = np.zeros((len(words), chances.shape[1]))
    padded = np.vstack([chances, np.zeros(chances.shape[1])])
    for places, some in same_length(words, pieces.longest + chances.shape[1]):
        if len(some[0]) <= block_size(padded):
            out[places] = np.log(np.maximum(_whole(pieces.lattice(some), padded)[-1], 1e-300))
            continue
        for place, word in zip(places.tolist(), some, strict=True):
            for *_, alpha, scale in _blocks(word, pieces, padded):
                last = alpha[-1, 0]
            out[place] = np.log(np.maximum(last, 1e-300)) + scale
    return out


def expected_counts(words: list[str], counts: np.ndarray, pieces: Pieces, chances: np.ndarray) -> np.ndarray:
    """Expected uses (piece) of one language's pieces over counted words, by forward and backward sums."""
    uses = np.zeros(pieces.size)
    padded = np.append(chances, 0.0)

    def back(lattice, alpha, beta, weight, first):
        """Adds the uses that end after ``first`` and takes ``beta`` down to 0."""
        for end in range(len(lattice) - 1, first, -1):
            for length in range(1, min(pieces.longest, end) + 1):
                number = lattice[end, length - 1]
                there = np.flatnonzero(number >= 0)
                if len(there):
                    passed = padded[number[there]] * beta[end, there]
                    np.add.at(uses, number[there], alpha[end - length, there] * passed * weight[there])
                    beta[end - length, there] += passed

    for places, some in same_length(words, pieces.longest + 2):
        if len(some[0]) <= block_size(padded):
            lattice = pieces.lattice(some)
            alpha = _whole(lattice, padded[:, None])[:, :, 0]
            beta = np.zeros(alpha.shape)
            beta[-1] = 1
            back(lattice, alpha, beta, counts[places] / np.maximum(alpha[-1], 1e-300), 0)
            continue
        for place, word in zip(places.tolist(), some, strict=True):
            # Each block's sums are held under a scale of its own; those of endings follow it from block to block.
            steps = list(_blocks(word, pieces, padded[:, None]))
            total = np.maximum(steps[-1][3][-1, 0, 0], 1e-300)
            later, logs = np.ones((1, 1)), -np.log(total) - steps[-1][4][0]
            for _, held, lattice, alpha, scale in reversed(steps):
                beta = np.zeros(alpha.shape[:2])
                beta[-len(later) :] = later
                back(lattice, alpha[:, :, 0], beta, counts[[place]] * np.exp(logs + scale[0]), held)
                later = beta[: held + 1]
                most = max(later.max(), 1e-300)
                later, logs = later / most, logs + np.log(most)
    return uses


class LanguageModel:
    def __init__(self, languages: list[str], pieces: list[str], chances: np.ndarray):
        self.languages, self.pieces, self.chances = languages, pieces, chances
        self._found: Pieces | None = None

    def __getstate__(self):
        return self.__dict__ | {"_found": None}

    def scorer(self):
        """texts -> (language, score) for each, with a bounded memory of words."""
        pieces = self._found = self._found or Pieces(self.pieces)
        place: dict[str, int] = {}
        scores, lettered = np.zeros((0, len(self.languages))), np.zeros(0, bool)

        def score(texts: list[str | None]) -> list[tuple[str, float]]:
            nonlocal scores, lettered
            runs = [letter_runs(t) if t else [] for t in texts]
            new = list(set().union(*runs).difference(place))
            if len(place) + len(new) > REMEMBERED:
                place.clear()
                scores, lettered = np.zeros((0, len(self.languages))), np.zeros(0, bool)
                new = list(set().union(*runs))
            if new:
                # \w also holds numerals such as the superscript two, which aren't letters.
                kept = [w if w.isalpha() else "".join(filter(str.isalpha, w)) for w in new]
                place.update(zip(new, range(len(scores), len(scores) + len(new)), strict=True))
                scores = np.concatenate([scores, word_scores(kept, pieces, self.chances)])
                lettered = np.concatenate([lettered, np.fromiter(map(bool, kept), bool, len(kept))])
            sizes = np.fromiter(map(len, runs), np.int64, len(runs))
            places = np.fromiter(map(place.__getitem__, chain.from_iterable(runs)), np.int64, int(sizes.sum()))
            best = [("und", 0.0)] * len(texts)
            some = np.flatnonzero(sizes)
            if len(some) and self.languages:
                starts = (np.cumsum(sizes) - sizes)[some]
                totals = np.add.reduceat(scores[places], starts, axis=0)
                letters = np.add.reduceat(lettered[places].astype(np.int64), starts)
                likeliest = totals.argmax(axis=1)
                posteriors = 1 / np.exp(totals - totals.max(axis=1, keepdims=True)).sum(axis=1)
                for row, n, k, p in zip(some.tolist(), letters.tolist(), likeliest.tolist(), posteriors.tolist(), strict=True):
                    if n:
                        best[row] = (self.languages[k], p)
            return best

        return score


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}

    def out():
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["lang", "word", "n"])

    for batch in slices(batches, "text"):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            counts.setdefault(lang, Counter()).update(filter(str.isalpha, letter_runs(text or "")))
        if sum(map(len, counts.values())) > REMEMBERED:
            yield out()
    if any(counts.values()):
        yield out()


def fit(
    docs: DataFrame, *, vocabulary: str | None = None, sample_docs: int = SAMPLE_DOCS, rounds: int = ROUNDS
) -> LanguageModel:
    """Learn from the rows of ``docs`` with a text and a lang."""
    spark = docs.sparkSession
    names = vocabulary_pieces(vocabulary or default_vocabulary())
    labelled = docs.where("text is not null and lang is not null").select("doc_id", "lang", "text")
    sizes = dict(labelled.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect())
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages; raise MOST_LANGUAGES")
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], names, np.zeros((len(names) + 1, 0)))
    # The id spreads the copies of a text; it only picks rows, it isn't learned from.
    share = F.create_map(*(F.lit(x) for k in languages for x in (k, min(1.0, sample_docs / sizes[k]))))
    picked = labelled.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003)
    words = picked.select("lang", "text").mapInArrow(_word_counts, "lang string, word string, n long")
    words = materialise(words.groupBy("lang", "word").agg(F.sum("n").alias("n")), "lang-words")

    chances = np.full((len(names) + 1, len(languages)), 1.0 / (len(names) + 1))
    for _ in range(rounds):
        held = spark.sparkContext.broadcast((names, languages, chances))

        def expect(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            names, languages, chances = held.value
            pieces = Pieces(names)
            uses = np.zeros(chances.shape)
            for batch in batches:
                lang = np.array(batch.column("lang").to_pylist(), dtype=object)
                words = np.array(batch.column("word").to_pylist(), dtype=object)
                counts = batch.column("n").to_numpy().astype(float)
                for k, name in enumerate(languages):
                    own = np.flatnonzero(lang == name)
                    if len(own):
                        uses[:, k] += expected_counts(words[own].tolist(), counts[own], pieces, chances[:, k])
            piece, language = np.nonzero(uses)
            yield pa.RecordBatch.from_arrays(
                [pa.array(piece, pa.int64()), pa.array(language, pa.int64()), pa.array(uses[piece, language])],
                names=["piece", "language", "uses"],
            )

        # At most pieces x languages sums reach the driver.
        sums = (
            words.mapInArrow(expect, "piece long, language long, uses double")
            .groupBy("piece", "language")
            .agg(F.sum("uses").alias("uses"))
            .toPandas()
        )
        uses = np.full(chances.shape, PRIOR_COUNT)
        uses[sums["piece"], sums["language"]] += sums["uses"]
        chances = uses / uses.sum(axis=0)
        held.unpersist()
    return LanguageModel(languages, names, chances)


def predict(docs: DataFrame, model: LanguageModel, *, carry: list[str]) -> DataFrame:
    """The columns ``carry``, lang_pred and score of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = held.value.scorer()
        for batch in slices(batches, "text", 4 << 20):
            found = score(batch.column("text").to_pylist())
            out = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), *out], names=[*carry, "lang_pred", "score"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select(*carry, "text").mapInArrow(run, f"{fields}, lang_pred string, score double")
