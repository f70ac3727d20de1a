"""Operators on whole corpora: shards, packing, near duplicates, and the pipeline."""

import math
import random
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cuelake.llm import near_dedup, packing, quality_classifier, quality_rules, sharding
from cuelake.llm import queries as q

from .helpers import PROSE, documents, folder, odd_rows, plain_words, rows, spaced_words
from .test_labels import plain_scores
from .test_texts import plain_estimates, plain_overlap, plain_rules

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("shards, buckets", [(16, 4096), (5, 4)])
def test_shards_keep_counts_and_mixture(spark, shards, buckets):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = sharding.stratified_shards(docs, shards=shards, buckets=buckets).toPandas()
    sizes = found.groupby("shard").size()
    assert len(found) == docs.count() and len(sizes) == shards and sizes.max() - sizes.min() <= 1
    for _, own in found.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    mixture = found.groupby(["source", "shard"]).size().unstack(fill_value=0)
    assert (mixture.max(axis=1) - mixture.min(axis=1)).max() <= 2
    # Brute force: rank within the source by hash, then order all rows by fraction.
    placed = docs.withColumn("at", F.monotonically_increasing_id())
    hashed = placed.select("doc_id", sharding.shuffle_hash(sharding.SEED).alias("h")).toPandas().set_index("doc_id").h
    order = defaultdict(list)
    for r in found.itertuples():
        order[r.source].append((hashed[r.doc_id], r.doc_id))
    line = sorted(((k + 0.5) / len(own), h, s, d) for s, own in order.items() for k, (h, d) in enumerate(sorted(own)))
    assert found.set_index("position").doc_id.sort_index().tolist() == [d for _, _, _, d in line]


def test_shards_of_odd_rows(spark, tmp_path):
    found = q.op6_sharding(spark, folder(spark, tmp_path, documents=documents(spark)))
    wanted = [(r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in odd_rows()]
    assert rows(found.select("doc_id", "size", "text_crc32")) == sorted(wanted, key=repr)
    counts = Counter(r["shard"] for r in found.collect())
    assert set(counts.values()) == {1} and {(r["law"], r["grown_shard"]) for r in found.collect()} == {("rows", None)}
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert q.op6_sharding(spark, folder(spark, tmp_path / "e", documents=documents(spark, []))).collect() == []


def test_one_id_is_spread_over_hashes(spark):
    rows = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("at"))
    assert rows.select(sharding.shuffle_hash(sharding.SEED)).distinct().count() == 3000


def test_curve_visits_every_cell_once_by_steps_of_one():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    place = packing.hilbert_place(cells, 3)
    assert sorted(place) == list(range(512))
    path = cells[np.argsort(place)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_fast_and_slow_tokenizer_agree():
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(packing.default_vocabulary())
    fast = packing.encoder(packing.default_vocabulary())
    texts = [r[1] for r in odd_rows() if r[1]] + ["<|endoftext|> it's  a\n\n test\t 字 \u00a0 x", "\ud7ff\U0001f600 ' 's"]
    texts += ["<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|><|endoftext|>  y\n<|endoftext", "<|endoftext|>" * 300, "<|EndOfText|>"]
    assert list(fast(texts[-5])) == [50256]
    for text in texts:
        assert list(fast(text)) == slow.encode(text, add_special_tokens=False).ids


def check_packing(found, texts, sequence):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(packing.default_vocabulary())
    encode = lambda text: slow.encode(text, add_special_tokens=False).ids
    wanted = Counter()
    for doc, text in texts:
        ids = [*encode(text or ""), packing.END_ID]
        wanted[doc] += len(ids)
    whole = Counter()
    streams = defaultdict(list)
    for r in found:
        whole[r["doc_id"]] += r["length"]
        streams[r["sequence_id"]].append((r["offset"], r["length"]))
    assert whole == wanted
    for number, pieces in streams.items():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == sequence or (number == max(streams) and at < sequence)
    one_text = {doc: text for doc, text in texts}
    for r in found:
        ids = np.array([*encode(one_text[r["doc_id"]] or ""), packing.END_ID], "<u4")
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())


def test_packing_round_trip(spark, tmp_path):
    every = odd_rows() + [(40, "one <|endoftext|> two<|endoftext|>", "en", "a", 1)]
    found = q.op8_packing(spark, folder(spark, tmp_path, documents=documents(spark, every))).collect()
    check_packing(found, [r[:2] for r in every], packing.SEQUENCE)
    assert q.op8_packing(spark, folder(spark, tmp_path / "e", documents=documents(spark, []))).collect() == []


def test_packing_in_many_runs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = packing.pack(docs, sequence=128, run_tokens=1000).collect()
    check_packing(found, [tuple(r) for r in docs.select("doc_id", "text").collect()], 128)


def edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.randrange(10**6)}"
    return words


def plain_similarity(one, other):
    """Share of the longer word list that is aligned with the other one, by the plain table; 0 below 0.8."""
    longer = max(len(one), len(other))
    if not one or not other or sum((Counter(one) & Counter(other)).values()) * 5 < longer * 4:
        return 0.0
    places = np.array(list(map(hash, other)))
    row = np.zeros(len(other) + 1, np.int64)
    for word in one:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (places == hash(word))))
    return row[-1] / longer if row[-1] * 5 >= longer * 4 else 0.0


def plain_classes(texts, linked=plain_similarity):
    """The class of each key of ``texts`` (its least member), and the linked pairs of different texts."""
    words, root, links = {k: plain_words(t) for k, t in texts.items()}, {k: k for k in texts}, []

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(texts)
    for n, a in enumerate(keys):
        for b in keys[:n]:
            if texts[a] == texts[b] or linked(words[a], words[b]) > 0:
                if texts[a] != texts[b]:
                    links.append((b, a))
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {k: top(k) for k in texts}, links


def test_near_duplicates_by_brute_force(spark):
    rng = random.Random(11)
    texts = []
    for family in range(12):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([30, 120, 400]))]
        texts += [" ".join(base)] * rng.choice([1, 3]) + [" ".join(edited(rng, base, rng.randrange(1 + len(base) // 25))) for _ in range(8)]
        texts.append(" ".join(base[len(base) // 2 :] + base[: len(base) // 2]))
    passage = " ".join(f"p{k}" for k in range(40))
    texts += [passage + " " + " ".join(f"u{rng.randrange(10**5)}" for _ in range(25)) for _ in range(30)]
    every = [(k, t, "en", "a", 1) for k, t in enumerate(texts)] + [(1000 + (r[0] or 0), *r[1:]) for r in odd_rows()]
    found = near_dedup.near_duplicates(documents(spark, every)).collect()
    assert len(found) == len(every)
    wanted, _ = plain_classes({i: t for i, t, *_ in every if t is not None})
    for r in found:
        assert r["class_id"] == (wanted[r["doc_id"]] if r["text_md5"] is not None else r["doc_id"])
    kept = Counter(r["class_id"] for r in found if r["representative"] and r["text_md5"] is not None)
    assert set(kept) == set(wanted.values()) and set(kept.values()) == {1}


@pytest.mark.parametrize("least, share", [(0.8, 0.9), (0.9, 0.97)])
def test_recall_against_alignments_of_all_pairs(spark, least, share):
    """The measure is the table of a plain alignment over all pairs of a whole table, not the operator's own."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    found = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    wanted, links = plain_classes(texts)
    words = {k: plain_words(t) for k, t in texts.items()}
    links = [(a, b) for a, b in links if plain_similarity(words[a], words[b]) >= least]
    met = sum(found[a] == found[b] for a, b in links)
    assert len(links) > 20 and met >= share * len(links), (met, len(links))
    # Whatever is in one class is connected by links of all pairs.
    assert all(wanted[k] == wanted[c] for k, c in found.items())


@pytest.mark.parametrize("block", [500, 7])
def test_near_copies_in_a_crowded_group_meet(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(5)
    base = [f"w{k}" for k in range(200)]
    texts = []
    for family in range(60):
        # Two thirds are the base's own, so sketches of all families are often equal while families are no copies.
        own = rng.sample(range(200), 66)
        kind = [f"f{family}x{k}" if k in own else w for k, w in enumerate(base)]
        at = rng.randrange(100)
        kind = base[:at] + kind[at : at + 60] + [f"f{family}y{k}" for k in range(70)] + base[at + 130 :]
        texts += [" ".join(kind), " ".join(edited(rng, kind, 3))]
    texts += [" ".join(edited(rng, base, 4)) for _ in range(60)]
    found = near_dedup.near_duplicates(documents(spark, [(k, t, "en", "a", 1) for k, t in enumerate(texts)]))
    classes = {r["doc_id"]: r["class_id"] for r in found.collect()}
    wanted, links = plain_classes(dict(enumerate(texts)))
    assert len(links) >= 100 and len(set(wanted.values())) > 10
    assert classes == wanted


def test_alignment_similarity():
    seq = lambda t: near_dedup.word_numbers(t.encode()).astype(np.uint16)
    assert near_dedup.similarity(seq(PROSE), seq(PROSE.upper())) == 1.0
    assert near_dedup.similarity(seq("a b"), seq("a b c")) == 0.0 and near_dedup.similarity(seq(""), seq("")) == 0.0
    assert near_dedup.similarity(seq("a b c d"), seq("a b c d e")) == 0.8
    words = [f"w{k}" for k in range(104)]
    swapped = words[52:] + words[:52]
    assert near_dedup.similarity(seq(" ".join(words)), seq(" ".join(swapped))) == 0.0
    one = " ".join(words)
    other = " ".join(words[:50] + ["x"] + words[51:])
    assert near_dedup.similarity(seq(one), seq(other)) == pytest.approx(103 / 104)


@pytest.mark.parametrize("rows", [3, 512])
def test_alignment_equals_the_plain_table(monkeypatch, rows):
    monkeypatch.setattr(near_dedup, "ROWS", rows)
    rng = random.Random(rows)
    for _ in range(400):
        one = [rng.choice("abcdefgh" if rng.random() < 0.5 else "abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(1, 60))]
        other = list(one)
        for _ in range(rng.randrange(0, 8)):
            at = rng.randrange(len(other) + 1)
            other[at : at + rng.randrange(3)] = [rng.choice("abcxyz") for _ in range(rng.randrange(3))]
        number = lambda x: np.array([ord(c) for c in x], np.uint16)
        assert near_dedup.similarity(number(one), number(other)) == pytest.approx(plain_similarity(one, other))


def test_very_long_texts_align_in_bounded_memory():
    rng = np.random.default_rng(1)
    one = rng.integers(0, 1 << 16, 60_000).astype(np.uint16)
    other = np.delete(one, rng.choice(len(one), 300, replace=False))
    assert near_dedup.similarity(one, other) == pytest.approx(59_700 / 60_000)
    assert near_dedup.similarity(one, rng.permutation(one)) == 0.0


def test_near_duplicates_empty(spark, tmp_path):
    assert q.op10_near_dedup(spark, folder(spark, tmp_path, documents=documents(spark, []))).collect() == []


def test_chains_are_one_component(spark):
    links = spark.createDataFrame([(f"{k:03d}".encode(), f"{k + 1:03d}".encode()) for k in range(40) if k != 20], "a binary, b binary")
    found = {bytes(r["node"]): bytes(r["root"]) for r in near_dedup.components(links).collect()}
    assert set(found.values()) == {b"000", b"021"} and found[b"020"] == b"000" and found[b"040"] == b"021"


def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], sf).cache())
    return out


def test_pipeline_by_brute_force(spark):
    """Every stage's rows by a plain version of its rule, over what the stage before has kept."""
    raw, ruled, good, unique, clean, packed = stages(spark, SF)
    of = lambda frame: {r["doc_id"]: r.asDict() for r in frame.collect()}
    raw_rows, ruled_rows, good_rows, unique_rows, clean_rows = map(of, (raw, ruled, good, unique, clean))
    # Rules: base columns and statistics in plain Python, the estimate in numpy.
    vectors, by_id, failed = defaultdict(list), {}, set()
    for i, r in raw_rows.items():
        n, chars, symbols, dup, repeated, fails = plain_rules(r["text"])
        words, text = spaced_words(r["text"]), r["text"] or ""
        lines = sum(bool(spaced_words(x)) for x in text.split("\n"))
        upper = sum(unicodedata.category(c) == "Lu" for c in text)
        x = [
            math.log((chars + 100) / (n + 20)), math.log1p(10 * symbols / (n + 5)), math.sqrt(dup / (lines + 2)), math.sqrt(repeated / max(n, 1)),
            math.sqrt(upper / max(chars, 1)), math.log((len(set(words)) + 1) / (max(n, 1) ** 0.85 + 1)),
        ]
        by_id[i] = x
        vectors[r["lang"], r["source"]].append(x)
        if fails:
            failed.add(i)
    estimates, floors = plain_estimates(vectors)
    wanted = set()
    for i, r in raw_rows.items():
        _, mean, matrix = estimates[r["lang"], r["source"]]
        z = np.array(by_id[i]) - mean
        if i not in failed and z @ np.linalg.inv(matrix + floors) @ z <= quality_rules.CUT:
            wanted.add(i)
    assert set(ruled_rows) == wanted
    # Classifier: the fitted weights applied in plain Python.
    model = quality_classifier.fit(ruled.where(~q.held_out(F.col("doc_id"), 4, 2)), spark.read.parquet(f"{SF}/labels.parquet"))
    scores = plain_scores(model, [r["text"] for r in ruled_rows.values()])
    assert set(good_rows) == {i for i, s in zip(ruled_rows, scores, strict=True) if s >= quality_classifier.THRESHOLD}
    # Near copies: all pairs.
    seqs = {i: plain_words(r["text"]) for i, r in good_rows.items()}
    first = {i: i for i in sorted(seqs)}

    def top(i):
        while first[i] != i:
            i = first[i]
        return i

    for b in first:
        for a in first:
            if a < b and (good_rows[a]["text"] == good_rows[b]["text"] or plain_similarity(seqs[a], seqs[b]) > 0):
                x, y = sorted((top(a), top(b)))
                first[y] = x
    assert set(unique_rows) == {top(i) for i in first}
    # Contamination: all windows. Rows are as they were but for passages that were cut.
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    judged = {i: plain_overlap(r["text"], items, 13) for i, r in unique_rows.items()}
    assert set(clean_rows) == {i for i, j in judged.items() if not j[4]}
    for i, r in clean_rows.items():
        assert (r == raw_rows[i]) == (judged[i][1] == 0)
        assert plain_overlap(r["text"], items, 13)[0] == judged[i][0] - judged[i][1]
    check_packing(packed.collect(), [(i, r["text"]) for i, r in clean_rows.items()], packing.SEQUENCE)
    assert rows(corpus_pipeline.run(spark, SF)) == rows(packed)


def test_passages_below_the_limit_are_cut(spark, tmp_path):
    item = " ".join(f"b{k}" for k in range(13))
    own = " ".join(f"w{k}" for k in range(400))
    sf = folder(spark, tmp_path, benchmark=spark.createDataFrame([(1, item)], "item_id long, text string"))
    docs = documents(spark, [(1, f"{own} {item} {own}", "en", "a", 7), (2, f"{item} few", "en", "a", 7), (3, own, "en", "a", None)])
    found = {r["doc_id"]: r for r in corpus_pipeline.drop_contaminated(spark, docs, sf).collect()}
    assert set(found) == {1, 3} and found[1]["text"] == f"{own}  {own}" and found[1]["n_chars"] == len(found[1]["text"])
    assert (found[3]["text"], found[3]["n_chars"]) == (own, None)


def test_pipeline_takes_odd_rows(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, PROSE)], "item_id long, text string")
    for name, some in (("odd", odd_rows()), ("none", [])):
        sf = folder(spark, tmp_path / name, documents=documents(spark, some), labels=labels, benchmark=benchmark)
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            frame = stage(spark, docs, sf)
            assert frame.columns == docs.columns
            frame.collect()
        corpus_pipeline.run(spark, sf).collect()


def test_dedup_stage_keeps_one_of_repeated_rows(spark, tmp_path):
    docs = documents(spark)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").select("doc_id", "text").collect()
    ids = Counter(r["doc_id"] for r in kept)
    assert ids[1] == 1 and ids[2] == 0 and ids[5] == 2 and ids[4] == 1
