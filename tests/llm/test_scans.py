"""Secret scans, whitening and importance resampling against plain versions of their rules."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cuelake.llm import importance, secret_scan, whitening
from cuelake.llm import queries as q

from .helpers import documents, folder, odd_rows, plain_words, rows

SF = "/root/testdata/sf0.01"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_entropy(window):
    return -sum(n / len(window) * math.log2(n / len(window)) for n in Counter(window).values())


def plain_spans(text):
    """(start, kind, end) of every span; entropies are computed anew for every window."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    for m in re.finditer(r"[A-Za-z0-9+/_-]+", text):
        run = m[0]
        if re.search("|".join(secret_scan.ALLOWED), run, re.I) or not re.search("[A-Za-z]", run):
            continue
        spans = []
        for i in range(len(run) - 15):
            window = run[i : i + 16]
            least = 2.8 if re.fullmatch("[0-9a-fA-F]+", window) else 3.4
            if 0 < sum(c.isdigit() for c in window) < 16 and plain_entropy(window) >= least - 1e-6:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + 16
                else:
                    spans.append([i, i + 16])
        found += [(m.start() + a, 3, m.start() + b) for a, b in spans]
    return sorted(found)


def joined(spans):
    return ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secret_texts():
    pick = random.Random(11)

    def junk():
        letters = pick.choice(["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcd0123", "aZ9+/_-b", "0123456789", "e"])
        return "".join(pick.choice(letters) for _ in range(pick.choice([5, 15, 16, 17, 30, 40, 90])))

    parts = [" ", "é字 ", "\n", "=", ": ", "token=", "API_KEY: '", "secret", 'passwd"  = ', "AKIA", "\U0001f600", "example", '"']
    texts = ["".join(pick.choice([*parts, junk(), junk(), junk()]) for _ in range(pick.randint(0, 25))) for _ in range(400)]
    texts += ["token=token=abc", "api_key=token:abcdefgh", "toſken=abcdefgh", "toKen=abcdefgh", "token=", "AKIA", "AKIA" + "A" * 15]
    # More matches than one block of running sums holds, and a candidate of many runs.
    texts += [" ".join(["token=abc123def456"] * 700), "/".join(["f3a9c1d7e5b20864" + "a" * 20] * 60)]
    return texts


def test_secrets_by_brute_force(spark):
    texts = secret_texts()
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = secret_scan.scan(frame, carry=["doc_id"]).select("doc_id", secret_scan.as_text(F.col("secrets")).alias("s"))
    assert {r["doc_id"]: r["s"] for r in found.collect()} == {n: joined(plain_spans(t)) for n, t in enumerate(texts)}


def test_secrets_of_odd_rows(spark, tmp_path):
    found = q.op11_secret_scan(spark, folder(spark, tmp_path, documents=documents(spark)))
    wanted = []
    for r in odd_rows():
        spans = plain_spans(r[1] or "")
        kinds = Counter(k for _, k, _ in spans)
        base = hashlib.sha256(joined([s for s in spans if s[1] < 3]).encode()).hexdigest()
        wanted.append((r[0], kinds[0], kinds[1], kinds[2], kinds[3], base, joined(spans)))
    assert rows(found) == sorted(wanted, key=repr)
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert q.op11_secret_scan(spark, folder(spark, tmp_path / "e", documents=documents(spark, []))).collect() == []


def test_allow_list_of_the_caller(spark):
    frame = spark.createDataFrame([("key q7Fz91LmXw03TbNc5R",), ("key 9f86d081884c7d65-0a2f",)], "text string")
    count = lambda **kept: [len(r["secrets"]) for r in secret_scan.scan(frame, carry=["text"], **kept).orderBy("text").collect()]
    assert count() == [1, 1] and count(allowed=()) == [1, 1] and count(allowed=("^q7fz",)) == [1, 0]


@pytest.mark.parametrize("dims", [1, 2, 5, 16, 33])
def test_rotations_find_singular_values_to_working_precision(dims):
    table = np.random.default_rng(dims).normal(size=(200, dims)) * np.logspace(0, -8, dims)
    lengths, vectors = whitening.one_sided_jacobi(whitening.triangle(table))
    wanted = np.linalg.svd(table, compute_uv=False)
    assert np.allclose(lengths, wanted, rtol=1e-6, atol=0) and np.abs(vectors.T @ vectors - np.eye(dims)).max() < 1e-12
    graded = table[:dims] if dims > 1 else table
    assert np.allclose(np.linalg.norm(graded @ vectors, axis=0), np.linalg.norm(graded @ np.linalg.svd(table)[2].T, axis=0), rtol=1e-4)


def check_whitening(found, vectors, dims):
    """found: rows by id. vectors: id to entries, the kept ones. Everything recomputed from the definition."""
    grid = {k: tuple(math.floor(256 * c) for c in v) for k, v in vectors.items()}
    fit = sorted(set(grid.values()))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array(fit) - np.array(sums) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    signs = {}
    for (key, component), r in found.items():
        x = grid[key]
        assert r["n"] == n and r["deviation"] == sum((n * c - s) ** 2 for c, s in zip(x, sums))
        assert abs(r["explained"] - values[component - 1] / values.sum()) <= 1e-9
        z = (np.array(x) - np.array(sums) / n) @ axes[:, component - 1] / math.sqrt(values[component - 1])
        if abs(z) > 1e-3:
            sign = signs.setdefault(component, math.copysign(1, z * r["whitened"]))
            assert abs(sign * z - r["whitened"]) < 1e-7 * max(1, abs(z))
        assert 0 <= r["identity_error"] < 1e-9
    assert {k for k, _ in found} == set(grid) and {c for _, c in found} == set(range(1, min(4, dims) + 1))


@pytest.mark.parametrize("fan", [2, 32])
def test_whitening_by_brute_force(spark, monkeypatch, fan):
    monkeypatch.setattr(whitening, "FAN", fan)
    monkeypatch.setattr(whitening, "BLOCK", 50)
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    spread = table.repartition(7)
    found = {(r["vec_id"], r["component"]): r for r in whitening.whiten(spread).collect()}
    check_whitening(found, {r["vec_id"]: r["embedding"] for r in table.collect()}, 64)


def test_whitening_of_odd_rows(spark, tmp_path):
    pick = np.random.default_rng(2)
    good = {n: [float(c) for c in np.float32(pick.normal(size=6))] for n in range(20)}
    same = [(100 + n, good[3]) for n in range(30)]
    odd = [(50, None), (51, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (52, [float("nan")] * 6), (53, [float("inf")] + [0.0] * 5), (54, [-0.0] * 6)]
    table = [(k, v, 1) for k, v in [*good.items(), *same, *odd]]
    frame = spark.createDataFrame(table, "vec_id long, embedding array<float>, x int")
    found = {(r["vec_id"], r["component"]): r for r in q.op12_whitening(spark, folder(spark, tmp_path, embeddings=frame)).collect()}
    kept = {k: v for k, v, _ in table if k not in (50, 51, 52, 53)}
    check_whitening(found, kept, 6)
    for name, few in (("none", []), ("one", [(1, [1.0, 2.0], 1)] * 3), ("bare", [(1, [], 1)])):
        frame = spark.createDataFrame(few, "vec_id long, embedding array<float>, x int")
        assert q.op12_whitening(spark, folder(spark, tmp_path / name, embeddings=frame)).collect() == []
    # Lacking entries are zeros; one axis of variance gives one component; ids may be null and repeated.
    few = [(None, [1.0, 2.0], 1), (7, [1.0], 1), (7, [1.0], 1)]
    frame = spark.createDataFrame(few, "vec_id long, embedding array<double>, x int")
    found = q.op12_whitening(spark, folder(spark, tmp_path / "few", embeddings=frame)).collect()
    assert sorted((str(r["vec_id"]), r["component"], r["n"], round(abs(r["whitened"]), 9), r["explained"]) for r in found) == [
        ("7", 1, 2, 1.0, 1.0), ("7", 1, 2, 1.0, 1.0), ("None", 1, 2, 1.0, 1.0)]


def test_whitening_beyond_64_bits(spark):
    rows_ = [(n, [1e300 * (n - 1), float(n * n)]) for n in range(3)]
    frame = spark.createDataFrame(rows_, "vec_id long, embedding array<double>")
    # The ends of the grid are -2^63 and 2^63 - 1, so the first sum is -1.
    assert {r["vec_id"]: r["deviation"] for r in whitening.whiten(frame).collect()} == {0: None, 1: 1 + (3 * 256 - 5 * 256) ** 2, 2: None}


def plain_buckets(text, most_words):
    words = plain_words(text)
    return [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in range(1, most_words + 1) for i in range(len(words) - n + 1)]


@pytest.mark.parametrize("most_words", [1, 3])
def test_word_hashes_by_brute_force(most_words):
    pick = random.Random(3)
    texts = [r[1] for r in odd_rows()] + ["a" * 64, "a" * 65, "b" * 63, "A" * 1000, "", "x", "y", "é" * 100]
    texts += ["".join(pick.choice("aZ09é ,.字_\n-") for _ in range(pick.randint(0, 200))) for _ in range(300)]
    column = pa.array(["other word", *texts, None], pa.string()).slice(1)
    found = [[] for _ in texts] + [[]]
    for text, bucket in importance.features(column, most_words, 10_000):
        for at, b in zip(text, bucket):
            found[at].append(int(b))
    for text, own in zip([*texts, None], found):
        assert sorted(own) == sorted(plain_buckets(text, most_words))


def plain_draw(docs, items, most_words=1):
    s, t = Counter(), Counter()
    for text in docs.values():
        s.update(plain_buckets(text, most_words))
    for text in items:
        t.update(plain_buckets(text, most_words))
    total, wanted = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (total + 10_000) / ((s[b] + 1) * (wanted + 10_000)))) for b in s}
    out = {}
    for key, text in docs.items():
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        own = plain_buckets(text, most_words)
        weight = sum(gain[b] for b in own)
        out[key] = [len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    able = sorted((-out[k][2], k) for k, text in docs.items() if len(plain_words(text)) >= 20)
    for rank, (_, k) in enumerate(able[: 10 * len(able) // 100], 1):
        out[k][3] = rank
    return out


@pytest.mark.parametrize("most_words", [1, 2])
def test_importance_by_brute_force(spark, most_words):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    found = importance.resample(docs.repartition(5), items, most_words=most_words).collect()
    wanted = plain_draw({r["doc_id"]: r["text"] for r in docs.collect()}, [r["text"] for r in items.collect()], most_words)
    assert {r["doc_id"]: list(r)[1:] for r in found} == wanted and any(r["rank"] for r in found)


def test_importance_of_odd_rows(spark, tmp_path):
    items = spark.createDataFrame([(1, None), (None, "der Haus am See"), (2, "")], "item_id long, text string")
    found = q.op13_importance(spark, folder(spark, tmp_path, documents=documents(spark), benchmark=items))
    numbers = [len(plain_words(r[1])) for r in odd_rows()]
    assert sorted(r["n_features"] for r in found.collect()) == sorted(numbers)
    drawn = sorted(r["rank"] for r in found.collect() if r["rank"])
    assert drawn == list(range(1, 10 * sum(n >= 20 for n in numbers) // 100 + 1))
    assert {r["weight"] for r in found.where("n_features = 0").collect()} == {0}
    none = folder(spark, tmp_path / "e", documents=documents(spark, []), benchmark=items.limit(0))
    assert q.op13_importance(spark, none).collect() == []


def test_rows_of_one_score_take_gapless_ranks(spark):
    same = spark.createDataFrame([(None, "wort " * 25)] * 400 + [(n, "wort " * 25) for n in range(100)], "doc_id long, text string")
    found = importance.resample(same.repartition(6), same.limit(1)).collect()
    assert sorted(r["rank"] for r in found if r["rank"]) == list(range(1, 51))
    ordered = sorted((r["score"] for r in found), reverse=True)
    assert [r["score"] for r in sorted((r for r in found if r["rank"]), key=lambda r: r["rank"])] == ordered[:50]
