"""Operators that learn from labels: language, quality, and the language model."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelake.llm import lang_id, lm_score, quality_classifier
from cuelake.llm import queries as q

from .helpers import UPPER, documents, fold, folder, odd_rows, spaced_words

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("block", [64, 5, 4])
def test_forward_sum_is_the_sum_over_segmentations(monkeypatch, block):
    monkeypatch.setattr(lang_id, "BLOCK", block)
    names = ["a", "ab", "b", "ba", "abab"]
    pieces = lang_id.Pieces(names)
    chances = np.random.default_rng(0).random((len(names) + 1, 3))

    def over_all(word):
        """Sums over segmentations of the word, and over uses of each piece in them."""
        total, uses = np.zeros(3), np.zeros((len(names) + 1, 3))
        if not word:
            return np.ones(3), uses
        for size in range(1, len(word) + 1):
            k = names.index(word[:size]) if word[:size] in names else len(names) if size == 1 else -1
            if k >= 0:
                rest, more = over_all(word[size:])
                total += chances[k] * rest
                uses += chances[k] * more
                uses[k] += chances[k] * rest
        return total, uses

    words = ["a", "ab", "abab", "xabba", "ababababab", "zz", "b", "abbababbxaba", "bababababababb"]
    assert np.allclose(lang_id.word_scores(words, pieces, chances), np.log([over_all(w)[0] for w in words]))
    counts = np.array([2.0, 1, 3, 1, 1, 1, 4, 2, 5])
    uses = lang_id.expected_counts(words, counts, pieces, chances[:, 0])
    assert np.allclose(uses, sum(n * over_all(w)[1][:, 0] / over_all(w)[0][0] for w, n in zip(words, counts, strict=True)))
    # Expected uses weighted by length add up to the letters.
    lengths = np.array([*map(len, names), 1])
    assert math.isclose((uses * lengths).sum(), (counts * [len(w) for w in words]).sum())


def test_runs_of_any_length_and_all_pieces_count():
    names = lang_id.vocabulary_pieces(lang_id.default_vocabulary())
    assert "absolutely" in names and "characteristics" in names
    pieces = lang_id.Pieces(["aab", "a"])
    chances = np.array([[0.3], [0.5], [0.1]])
    # f(n) = 0.5 f(n-1) in a's alone; each b ends an "aab" or stands alone.
    long = ("a" * 7 + "b") * 4000
    one = lang_id.word_scores(["aaaaaaab"], pieces, chances)[0, 0]
    assert lang_id.word_scores([long], pieces, chances)[0, 0] == pytest.approx(4000 * one)
    uses = lang_id.expected_counts([long], np.array([2.0]), pieces, chances[:, 0])
    assert np.allclose(uses, 8000 * lang_id.expected_counts(["aaaaaaab"], np.array([1.0]), pieces, chances[:, 0]))


@pytest.mark.parametrize("letters", [60, 64, 65, 5000])
def test_unlikely_runs_are_told_apart(letters):
    """Against exact logarithms: one letter at a time there is one segmentation only, far below the least number."""
    pieces = lang_id.Pieces(["a", "b"])
    chances = np.array([[2e-7, 1e-5, 1e-12], [0.5, 0.5, 1e-9], [1e-3, 1e-3, 0.5]])
    scores = lang_id.word_scores(["a" * letters], pieces, chances)[0]
    assert scores == pytest.approx(letters * np.log(chances[0]))
    # Two pieces: f(n) = p f(n-1) + q f(n-2), in logarithms.
    pieces, (p, q) = lang_id.Pieces(["a", "aa"]), (3e-9, 4e-8)
    logs = [0.0, math.log(p)]
    while len(logs) <= letters:
        logs.append(np.logaddexp(math.log(p) + logs[-1], math.log(q) + logs[-2]))
    assert lang_id.word_scores(["a" * letters], pieces, np.array([[p], [q], [0.1]]))[0, 0] == pytest.approx(logs[-1])
    uses = lang_id.expected_counts(["a" * letters], np.array([1.0]), pieces, np.array([p, q, 0.1]))
    assert uses[0] + 2 * uses[1] == pytest.approx(letters) and np.isfinite(uses).all()


def test_language_held_out(spark):
    found = q.op1_language_id(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    both = found.merge(docs, on="doc_id")
    assert len(found) == len(docs)
    assert all(h == fold(i, 4, 2) for i, h in zip(both.doc_id, both.held_out, strict=True))
    assert found.score.between(0, 1).all()
    unseen = both[both.held_out]
    assert (unseen.lang == unseen.lang_pred).mean() > 0.97
    # The query again by plain sums: of every text's words under the fitted chances, and the posterior of the best.
    texts = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null").withColumn("held_out", q.held_out(F.col("doc_id"), 4, 2))
    model = lang_id.fit(texts.where(~F.col("held_out")))
    pieces = lang_id.Pieces(model.pieces)
    shown = found.set_index("doc_id")
    for r in texts.limit(20).collect():
        words = lang_id.letter_runs(r["text"])
        totals = lang_id.word_scores(words, pieces, model.chances).sum(axis=0)
        k = totals.argmax()
        assert shown.lang_pred[r["doc_id"]] == model.languages[k]
        assert shown.score[r["doc_id"]] == pytest.approx(1 / np.exp(totals - totals[k]).sum())


def test_language_odd_rows(spark, tmp_path):
    found = q.op1_language_id(spark, folder(spark, tmp_path, documents=documents(spark))).collect()
    assert len(found) == len(odd_rows())
    by_id = {r["doc_id"]: r for r in found}
    for k in (4, 5, 6, 7):
        assert (by_id[k]["lang_pred"], by_id[k]["score"]) == ("und", 0.0)
    assert by_id[8]["lang_pred"] in {"de", "en"} and by_id[None]["lang_pred"] in {"de", "en"}
    assert by_id[11]["lang_pred"] in {"de", "en"} and 0.5 <= by_id[11]["score"] <= 1
    empty = q.op1_language_id(spark, folder(spark, tmp_path / "e", documents=documents(spark, [])))
    assert empty.collect() == []


def test_quality_held_out(spark):
    found = q.op4_quality_classifier(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    both = found.merge(labels, on="doc_id")
    unseen = both[both.held_out]
    assert found.score.between(0, 1).all() and (found.predicted == (found.score >= 0.7)).all()
    assert (unseen.predicted == unseen.quality).mean() > 0.95


def test_quality_odd_rows(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 0, 0), (8, 0, 0), (None, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    sf = folder(spark, tmp_path, documents=documents(spark), labels=labels)
    found = q.op4_quality_classifier(spark, sf).collect()
    assert len(found) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in found)
    by_text = {}
    for r, row in zip(sorted(found, key=lambda r: repr(r["doc_id"])), sorted(odd_rows(), key=lambda r: repr(r[0])), strict=True):
        assert by_text.setdefault(row[1] or "", r["score"]) == r["score"]
    nothing = folder(spark, tmp_path / "n", documents=documents(spark, []), labels=labels.limit(0))
    assert q.op4_quality_classifier(spark, nothing).collect() == []
    unlabelled = folder(spark, tmp_path / "u", documents=documents(spark), labels=labels.limit(0))
    assert {r["score"] for r in q.op4_quality_classifier(spark, unlabelled).collect()} == {0.5}


def test_prior_and_risk_on_a_known_mixture():
    rng = np.random.default_rng(3)
    good, bad = rng.normal(1.5, 1, (3000, 2)), rng.normal(-2.5, 1, (1000, 2))
    ones = lambda x: np.hstack([x, np.ones((len(x), 1))])
    positive, unlabelled = ones(rng.normal(1.5, 1, (2000, 2))), ones(rng.permutation(np.vstack([good, bad])))
    prior = quality_classifier.estimate_prior(positive, unlabelled, 300)
    assert abs(prior - 0.75) < 0.06
    w = quality_classifier._fit_risk(positive, unlabelled, prior, 300)
    assert (ones(good) @ w > 0).mean() > 0.95 and (ones(bad) @ w < 0).mean() > 0.95


@pytest.mark.parametrize("share", [0.05, 0.15, 0.98])
def test_prior_has_no_bounds_of_its_own(share):
    rng = np.random.default_rng(4)
    n = 8000
    good, bad = rng.normal(2, 1, (int(n * share), 2)), rng.normal(-2.5, 1, (n - int(n * share), 2))
    ones = lambda x: np.hstack([x, np.ones((len(x), 1))])
    prior = quality_classifier.estimate_prior(ones(rng.normal(2, 1, (4000, 2))), ones(rng.permutation(np.vstack([good, bad]))), 300)
    assert abs(prior - share) < 0.03


def plain_scores(model, texts):
    """The logistic score of each text, a sum at a time."""
    out = []
    for text in texts:
        z = model.weights[-1]
        for value, mean, scale, weight in zip(quality_classifier.features((text or "").encode()), model.mean, model.scale, model.weights, strict=False):
            z += weight * min(6.0, max(-6.0, (value - mean) / scale))
        out.append(1 / (1 + math.exp(-z)))
    return out


def test_quality_scores_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("held_out", q.held_out(F.col("doc_id"), 4, 2))
    model = quality_classifier.fit(docs.where(~F.col("held_out")), spark.read.parquet(f"{SF}/labels.parquet"))
    every = documents(spark).select("doc_id", "text").union(docs.select("doc_id", "text"))
    found = quality_classifier.predict(every, model, carry=["doc_id", "text"]).collect()
    assert len(found) == docs.count() + len(odd_rows())
    assert np.allclose([r["__score"] for r in found], plain_scores(model, [r["text"] for r in found]))


def plain_base(rows):
    train = [r for r in rows if not fold(r[0], 10, 0)]
    counts = Counter(w for r in train for w in spaced_words((r[1] or "").translate(UPPER)))
    n = sum(counts.values()) + len(train)
    distinct = len(counts) + bool(train)
    log = lambda c: math.log10((c + 0.1) / (n + 0.1 * (distinct + 1)))
    out = []
    for r in rows:
        words = spaced_words((r[1] or "").translate(UPPER))
        known = sum(counts[w] > 0 for w in words) + bool(train)
        out.append((r[0], fold(r[0], 10, 0), len(words) + 1, known, n, sum(log(counts[w]) for w in words) + log(len(train))))
    return out


@pytest.mark.parametrize("heavy", [0, 5, 10**6])
def test_base_score_by_brute_force(spark, heavy):
    docs = documents(spark).withColumn("held_out", q.held_out(F.col("doc_id"), 10, 0))
    model = lm_score.fit(docs.where(~F.col("held_out")), most_heavy=heavy)
    found = lm_score.score(docs, model, carry=["doc_id", "held_out"]).collect()
    wanted = sorted(plain_base(odd_rows()), key=repr)
    for r, w in zip(sorted(found, key=lambda r: repr((r["doc_id"], r["held_out"], r["n_tokens"]))), wanted, strict=True):
        assert (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], model.tokens) == w[:5]
        assert math.isclose(r["base_score"], w[5], rel_tol=1e-9)


def plain_places(text):
    """(symbols before, the word so far if it is long, symbol) at every place of a text."""
    stream = "\n" * lm_score.DEPTH + " ".join(spaced_words(text.translate(UPPER))) + "\n"
    for at in range(lm_score.DEPTH, len(stream)):
        word = re.split("[ \n]", stream[:at])[-1]
        yield stream[at - lm_score.DEPTH : at], word if len(word) >= lm_score.DEPTH - 1 else None, stream[at]


def plain_tree(texts, least_count, least_gain):
    """Next symbols' counts of all retained contexts: (depth, context), whole words at depth WORD."""
    counts = {}
    for text in texts:
        for before, word, symbol in plain_places(text or ""):
            keys = [(d, before[len(before) - d :]) for d in range(lm_score.DEPTH + 1 if word is None else lm_score.SHORT + 1)]
            for key in keys + [(lm_score.WORD, word)] * (word is not None):
                counts.setdefault(key, Counter())[symbol] += 1
    kept = {(0, ""): counts[0, ""]}
    for (depth, context), own in counts.items():
        if depth:
            size = lm_score.SHORT if depth == lm_score.WORD else depth - 1
            other = counts[size, context[len(context) - size :]]
            n, of = sum(own.values()), sum(other.values())
            if n >= least_count and sum(k * math.log(k / n / (other[x] / of)) for x, k in own.items()) >= least_gain:
                kept[depth, context] = own
    return kept


def plain_log10(kept, text):
    def chance(depth, context, symbol):
        own = kept[depth, context]
        shorter = [d for d in range(min(lm_score.SHORT, len(context)) if depth == lm_score.WORD else depth - 1, -1, -1) if (d, context[len(context) - d :]) in kept]
        under = chance(shorter[0], context[len(context) - shorter[0] :], symbol) if shorter else 1 / lm_score.SYMBOLS
        return (own[symbol] + lm_score.SMOOTHING * under) / (sum(own.values()) + lm_score.SMOOTHING)

    total = 0.0
    for before, word, symbol in plain_places(text):
        keys = [(lm_score.WORD, word)] if word is not None else []
        keys += [(d, before[len(before) - d :]) for d in range(lm_score.DEPTH if word is None else lm_score.SHORT, -1, -1)]
        total += math.log10(chance(*next(k for k in keys if k in kept), symbol))
    return total


@pytest.mark.parametrize("least_count, least_gain", [(3, 1.0), (1, 0.5)])
def test_suffix_tree_by_brute_force(spark, least_count, least_gain):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcde", k=rng.randint(1, 12))) for _ in range(60)]
    texts = [" ".join(rng.choices(words, weights=range(1, 61), k=rng.randint(0, 30))) for _ in range(120)] + [None, "", "Aa  b\tC"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    tree = lm_score.fit(docs, least_count=least_count, least_gain=least_gain).tree
    kept = plain_tree(texts, least_count, least_gain)
    byte_of = {int(n): b for b, n in enumerate(tree.symbols) if n < lm_score.SYMBOLS - 1}
    for depth in range(lm_score.DEPTH + 1):
        codes = tree.levels[depth][0].tolist()
        found = {"".join(chr(byte_of[code >> (lm_score.BITS * k) & 63]) for k in range(depth - 1, -1, -1)) for code in codes}
        assert found == {c for d, c in kept if d == depth} and len(found) == len(codes)
    stream = lm_score.Stream([" ".join(c for d, c in kept if d == lm_score.WORD).encode() + b"\n"], tree.symbols)
    ends = np.flatnonzero((stream.bytes <= 32) & stream.scored)
    assert sorted(stream.keys(ends).tolist()) == tree.levels[lm_score.WORD][0].tolist()
    assert tree.size == 1 + len(kept) and len(tree.levels[lm_score.WORD][0]) > 10
    every = np.arange(tree.size, dtype=np.uint32)
    sums = sum(tree._chances(every, np.full(tree.size, symbol, np.uint64)) for symbol in range(lm_score.SYMBOLS))
    assert np.allclose(sums, 1, atol=1e-4)
    asked = ["", "abc", words[3] + " " + words[50], " ".join(words), "eeeeeeeeeeeeeeeeeeeeee", *filter(None, texts[:20])]
    for text, got in zip(asked, tree.score([lm_score.words_of(t.encode()) for t in asked]), strict=True):
        assert math.isclose(plain_log10(kept, text), got, rel_tol=1e-5)


def test_language_model_beats_its_base_on_unseen_texts(spark):
    found = q.op9_lm_score(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert found[0] > 0.99 * found[1]


def test_language_model_odd_rows(spark, tmp_path):
    found = q.op9_lm_score(spark, folder(spark, tmp_path, documents=documents(spark))).collect()
    assert len(found) == len(odd_rows()) and all(math.isfinite(r["score"]) and r["score"] < 0 for r in found)
    by_id = {r["doc_id"]: r["score"] for r in found}
    assert by_id[4] == by_id[5] == by_id[6] > by_id[7]


def test_language_model_empty(spark, tmp_path):
    assert q.op9_lm_score(spark, folder(spark, tmp_path, documents=documents(spark, []))).collect() == []
