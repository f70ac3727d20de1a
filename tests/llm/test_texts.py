"""Operators on single texts and urls: rules, decontamination, urls, licences."""

import hashlib
import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from cuelake.llm import decontaminate, license_scan, quality_rules, url_filter
from cuelake.llm import queries as q

from .helpers import PROSE, documents, folder, odd_rows, plain_words, rows, spaced_words

SF = "/root/testdata/sf0.001"


def plain_rules(text):
    words = spaced_words(text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    counts = Counter(windows)
    repeated = {p for k, w in enumerate(windows) if counts[w] > 1 for p in range(k, k + 5)}
    lines = [x for x in (text or "").split("\n") if spaced_words(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(repeated), failed


def test_rules_base_by_brute_force(spark, tmp_path):
    more = [(20, "a b c d e f g\na b c d e f g\n\n# x\n# x", "en", "a", 1), (21, "w " * 4, "en", "a", 1), (22, "a a a a a a a a a a a", "en", "a", 1)]
    every = odd_rows() + more
    found = q.op2_quality_rules(spark, folder(spark, tmp_path, documents=documents(spark, every)))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert rows(found.select(names)) == sorted(((r[0], *plain_rules(r[1])) for r in every), key=repr)
    assert all(not r["kept"] for r in found.collect() if r["base_failed"])
    assert q.op2_quality_rules(spark, folder(spark, tmp_path / "e", documents=documents(spark, []))).collect() == []


def test_rules_reject_junk_and_keep_prose(spark):
    found = q.op2_quality_rules(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    both = found.merge(labels, on="doc_id")
    both = both[~both.base_failed]
    assert both[both.quality == 1].kept.mean() > 0.99
    assert both[both.quality == 0].kept.mean() < 0.2


def plain_estimates(vectors):
    """The least regularised covariance determinant of each (lang, source), leaning on its language and on all."""
    floors = np.diag(np.square(quality_rules.FLOORS))
    rank = lambda values, share: np.sort(values, axis=0)[math.ceil(share * len(values)) - 1]
    kept = {}
    for key, rows in vectors.items():
        x = np.unique(np.array(rows), axis=0)
        median = rank(x, 0.5)
        spread = 1.4826 * rank(np.abs(x - median), 0.5)
        signs = x - median
        norm = np.maximum((np.square(signs) / (np.square(spread) + np.diag(floors))).sum(axis=1), 1e-12)
        starts = [
            (median, np.diag(np.square(spread))),
            (x.mean(axis=0), np.cov(x.T, bias=True)),
            (median, 6 * (signs / norm[:, None]).T @ signs / len(x)),
        ]
        found = []
        for centre, matrix in starts:
            before = math.inf
            for _ in range(quality_rules.STEPS):
                z = x - centre
                d2 = (z @ np.linalg.inv(matrix + floors) * z).sum(axis=1)
                near = x[d2 <= rank(d2, quality_rules.SUBSET) * (1 + 1e-12)]
                centre, matrix = near.mean(axis=0), quality_rules.CONSISTENCY * np.cov(near.T, bias=True).reshape(6, 6)
                now = np.linalg.slogdet(matrix + floors)[1]
                if now > before - 1e-9:
                    break
                before = now
            found.append((np.linalg.slogdet(matrix + floors)[1], centre, matrix))
        kept[key] = (len(x), *min(found, key=lambda f: f[0])[1:])

    def pooled(some):
        n = sum(k for k, *_ in some)
        mean = sum(k * m for k, m, _ in some) / n
        return n, mean, sum(k * (c + np.outer(m, m)) for k, m, c in some) / n - np.outer(mean, mean)

    def lean(own, wider):
        w = own[0] / (own[0] + quality_rules.LEAN)
        return own[0], w * own[1] + (1 - w) * wider[1], w * own[2] + (1 - w) * wider[2]

    everything = pooled(list(kept.values()))
    tongues = {t: lean(pooled([v for (a, _), v in kept.items() if a == t]), everything) for t in {a for a, _ in kept}}
    return {key: lean(v, tongues[key[0]]) for key, v in kept.items()}, floors


def test_rules_by_a_plain_minimum_determinant(spark):
    rng = np.random.default_rng(2)
    rows = []
    for key, n in [(("en", "a"), 90), (("en", "b"), 13), (("de", "a"), 40), ((None, None), 3), (("de", None), 1)]:
        mix = rng.normal(0, 0.4, (6, 6))
        x = rng.normal(0, 1, (n, 6)) @ mix + rng.normal(0, 1, 6)
        x[: n // 5] += 8
        rows += [(*key, False, *v) for v in x.tolist()] + [(*key, True, *x[0].tolist())]
    names = "lang string, source string, base_failed boolean, " + ", ".join(f"__x{k} double" for k in range(6))
    stats = spark.createDataFrame(rows, names)
    found = quality_rules.judge(stats, quality_rules.fit(stats)).collect()
    vectors = {}
    for r in rows:
        vectors.setdefault(r[:2], []).append(r[3:])
    estimates, floors = plain_estimates(vectors)
    said = set()
    for r in found:
        _, mean, matrix = estimates[r["lang"], r["source"]]
        z = np.array([r[f"__x{k}"] for k in range(6)]) - mean
        d2 = z @ np.linalg.inv(matrix + floors) @ z
        assert r["distance2"] == pytest.approx(d2, rel=1e-6)
        assert r["kept"] == (not r["base_failed"] and d2 <= quality_rules.CUT)
        said.add((r["base_failed"], r["kept"]))
    assert said == {(True, False), (False, False), (False, True)}


def test_rules_keep_a_distance_equal_to_the_cut(spark):
    groups = quality_rules.fit(spark.createDataFrame([("en", "a", *[0.0] * 6)], "lang string, source string, " + ", ".join(f"__x{k} double" for k in range(6))))
    edge = quality_rules.FLOORS[5] * math.sqrt(quality_rules.CUT)
    rows = [("en", "a", False, *[0.0] * 5, edge * by) for by in (1 - 1e-12, 1 + 1e-9)] + [("xx", "new", False, *[0.0] * 6)]
    stats = spark.createDataFrame(rows, "lang string, source string, base_failed boolean, " + ", ".join(f"__x{k} double" for k in range(6)))
    assert [r["kept"] for r in quality_rules.judge(stats, groups).collect()] == [True, False, True]


def test_rules_run_no_python(spark):
    stats = quality_rules.statistics(documents(spark), ["doc_id", "lang", "source"])
    plan = quality_rules.judge(stats, quality_rules.fit(stats))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def plain_overlap(text, items, window):
    words = plain_words(text)
    hit, found = set(), set()
    for item, said in items:
        own = plain_words(said)
        size = min(window, len(own))
        if item is None or not own:
            continue
        windows = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)}
        for k in range(len(words) - size + 1):
            if tuple(words[k : k + size]) in windows:
                hit.update(range(k, k + size))
                found.add(str(item))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("block_words", [10**6, 8])
def test_overlap_by_brute_force(spark, block_words):
    rng = random.Random(7)
    items = [(k, " ".join(rng.choices("abcd", k=rng.randint(0, 9)))) for k in range(12)]
    items += [(3, "a b a b a"), (30, None), (None, "a a"), (31, "!!"), (32, "b b b b b b b b b")]
    texts = [" ".join(rng.choices("abcde", k=rng.randint(0, 60))) for _ in range(40)]
    every = [(k, t, "en", "a", 1) for k, t in enumerate(texts)] + odd_rows()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, every)
    found = decontaminate.find_overlap(docs, benchmark, carry=["doc_id"], window=4, block_words=block_words)
    shown = [
        (r["doc_id"], r["n_words"], r["n_hit"], len(r["item_ids"]), hashlib.sha256(",".join(r["item_ids"]).encode()).hexdigest(), r["contaminated"])
        for r in found.collect()
    ]
    assert sorted(shown, key=repr) == sorted(((r[0], *plain_overlap(r[1], items, 4)) for r in every), key=repr)


def test_overlap_query_and_cleaning(spark):
    duck = duckdb.connect()
    for name in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    ours = q.op3_decontamination(spark, SF)
    theirs = duck.execute(q.OP3_SQL).fetch_df()[ours.columns]
    assert rows(ours) == sorted(map(tuple, theirs.astype(object).values.tolist()), key=repr)
    docs = documents(spark, [(1, "Keep this. One two THREE four! and this", "en", "a", 1), (2, "one two", "en", "a", 1)])
    benchmark = spark.createDataFrame([(1, "one, two three four")], "item_id long, text string")
    found = {r["doc_id"]: r for r in decontaminate.find_overlap(docs, benchmark, carry=["doc_id"], clean=True).collect()}
    assert found[1]["cleaned_text"] == "Keep this. ! and this" and found[2]["cleaned_text"] is None
    assert [tuple(s) for s in found[1]["spans"]] == [(2, 6)]
    more = benchmark.union(spark.createDataFrame([(2, "this one"), (3, "and this")], benchmark.schema))
    for block_words in (10**6, 1):
        cleaned = decontaminate.find_overlap(docs, more, carry=["doc_id"], clean=True, block_words=block_words).collect()
        assert {r["doc_id"]: r["cleaned_text"] for r in cleaned} == {1: "Keep ", 2: None}
    assert decontaminate.decontaminate(docs, benchmark).select("doc_id").collect() == [(2,)]
    assert decontaminate.find_overlap(docs.limit(0), benchmark, carry=["doc_id"]).collect() == []
    assert {r["n_hit"] for r in decontaminate.find_overlap(docs, benchmark.limit(0), carry=["doc_id"]).collect()} == {0}


def plain_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = rest[:cut], rest[cut:]
        cut = min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])
        path = rest[:cut]
    host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    best = None
    for h, p, said in url_filter.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, said)
    return host, path, *(best or (None, None))


URLS = [
    "http://a.example.com/en/1", "https://www.example.com/en/x.html?q=1#f", "http://example.com", "http://EXAMPLE.COM/en/", "http://x.net/es/1",
    "http://x.net/es", "http://xnet/fr/", "http://net/fr/?a", "no scheme", "", None, "http://", "://com/", "http://q.org/en/9?utm=1&utm=2&b", "http://a.b://c.com/d",
    "http://host?x://com/", "http://a.com#/en/", "http://example.com/en/1", "http://example.com/en/1", "http://ü.net/fr/ä",
]


def test_urls_by_brute_force(spark, tmp_path):
    pages = spark.createDataFrame([(k, u, None, 1) for k, u in enumerate(URLS)], "page_id long, url string, html string, row int")
    found = q.op5_url_filter(spark, folder(spark, tmp_path, pages=pages)).collect()
    for r in found:
        host, path, rule, said = plain_url(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == said if said else r["verdict"] in ("allow", "block")
    assert len(found) == len(URLS)
    for rest in ([], [(1, None)]):
        few = spark.createDataFrame(rest, "page_id long, url string")
        assert len(q.op5_url_filter(spark, folder(spark, tmp_path / str(len(rest)), pages=few)).collect()) == len(rest)


def mined(spark, pages):
    """labelled rows, other rows (tokens, items, verdict), items and rules of urls."""
    host, path = url_filter.split_url(pages["url"])
    rule, verdict = url_filter.fixed_rule(host, path)
    urls = pages.select(pages["page_id"].alias("row"), url_filter.url_tokens(pages["url"], host, path).alias("tokens"), rule.alias("rule"), verdict.alias("verdict"))
    labelled = urls.where("rule is not null")
    items = url_filter.items_of(labelled, url_filter.SUPPORT)
    placed = urls.join(url_filter.with_items(urls, items), "row", "left").cache()
    baskets = placed.where("rule is not null and items is not null").select("row", "items", "verdict")
    return placed.where("rule is not null").collect(), placed.where("rule is null"), items, url_filter.mine(baskets)


def test_mined_rules_match_by_brute_force(spark):
    labelled, others, _, rules = mined(spark, spark.read.parquet(f"{SF}/pages.parquet"))
    found = [(set(r["tokens"]), r["confidence"]) for r in rules.collect()]
    seen = [(set(r["items"] or ()), r["verdict"]) for r in labelled]
    assert found
    for tokens, sure in found:
        said = [v for t, v in seen if tokens <= t]
        assert said.count("block") / len(said) == pytest.approx(sure) and sure >= url_filter.CONFIDENCE
        assert said.count("block") >= url_filter.SUPPORT * len(seen)
        assert len(tokens) <= url_filter.LONGEST and not any(t < tokens and s >= sure for t, s in found)
    wanted = {r["row"]: max(s for t, s in found if t <= set(r["items"] or ())) for r in others.collect() if any(t <= set(r["items"] or ()) for t, _ in found)}
    urls = others.where("items is not null").select("row", others["items"].alias("tokens"))
    assert {r["row"]: r["sure"] for r in url_filter.matches(urls, rules).collect()} == wanted


def test_deep_urls_and_templates_of_many_parameters(spark):
    many = "&".join(f"p{k}=1" for k in range(30))
    urls = [f"http://s{k}.a.b.c.d.net/es/x/y/{'bad' if k % 3 else 'z'}/q{k}?{many}" for k in range(300)]
    urls += [f"http://s{k}.a.b.c.d.com/es/x/y/z/{k}?{many if k % 2 else 'r=2'}" for k in range(300)]
    others = {"http://a.org/u/x/y/bad": "block", "http://a.org/es/x/y/bad/": "block", "http://a.org/": "allow"}
    pages = spark.createDataFrame([(k, u) for k, u in enumerate([*urls, *others])], "page_id long, url string")
    found = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages).collect()}
    assert [found[len(urls) + k] for k in range(len(others))] == list(others.values())
    labelled, _, items, _ = mined(spark, pages)
    same = [r["token"] for r in items.collect() if r["item"] == "query:p0"]
    assert sorted(same) == sorted(f"query:p{k}" for k in range(30))


def test_rule_beaten_by_one_two_tokens_shorter_goes(spark):
    baskets = [(["a", "b", "c"], "block")] * 6 + [(["a"], "block")] * 6 + [(["a", "b"], "allow")] * 5 + [(["a", "c"], "allow")] * 5 + [(["b"], "allow")] * 10
    baskets = [(k, t, v) for k, (t, v) in enumerate(baskets)]
    rules = url_filter.mine(spark.createDataFrame(baskets, "row long, items array<string>, verdict string"), support=0.05, confidence=0.5)
    found = {tuple(r["tokens"]): round(r["confidence"], 3) for r in rules.collect()}
    seen = [(set(t), v) for _, t, v in baskets]
    sure = lambda t: [v for s, v in seen if set(t) <= s].count("block") / max(1, sum(set(t) <= s for s, _ in seen))
    every = [("a",), ("b",), ("c",), ("a", "b"), ("a", "c"), ("b", "c"), ("a", "b", "c")]
    wanted = {t: round(sure(t), 3) for t in every if sure(t) >= 0.5 and not any(set(o) < set(t) and sure(o) >= max(0.5, sure(t)) for o in every)}
    assert found == wanted


def plain_licence(text):
    words = plain_words(text)
    places, labels = [], set()
    for phrase, label in license_scan.BASE_PHRASES:
        own = phrase.split()
        for k in range(len(words) - len(own) + 1):
            if words[k : k + len(own)] == own:
                places.append(k)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licences(spark, tmp_path):
    more = [
        (20, "Text. Licensed under the Apache License, Version 2.0.", "en", "a", 1),
        (21, "ALL RIGHTS RESERVED. Licensed under CC BY-NC 4.0; cc by", "en", "a", 1),
        (22, PROSE + " Released under the MIT License.\n" * 300, "en", "a", 1),
        (23, "the mit gave a license to apache; general public", "en", "a", 1),
        (24, "GNU General Public License, version 3; all\u212a rights reserved all rights", "en", "a", 1),
        (25, "This program: redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "en", "a", 1),
    ]
    every = odd_rows() + more
    found = q.op7_license_scan(spark, folder(spark, tmp_path, documents=documents(spark, every)))
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    assert rows(found.select(names)) == sorted(((r[0], *plain_licence(r[1])) for r in every), key=repr)
    labels = {r["doc_id"]: r["labels"] for r in found.collect()}
    assert labels[20] == "apache-2.0" and labels[22] == "mit" and labels[23] == ""
    assert labels[21] == "cc-by,cc-by-nc,reserved" and labels[25] == "gpl,gpl-notice"
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in found.collect())
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert q.op7_license_scan(spark, folder(spark, tmp_path / "e", documents=documents(spark, []))).collect() == []


def plain_share(template, words):
    """The largest share of a template's words that stand in order within some stretch of the words, a third longer than the template."""
    size, best = len(template) + len(template) // 3 + 2, 0
    for at in range(0, max(1, len(words) - len(template) // 2), max(1, len(template) // 8)):
        row = [0] * (len(template) + 1)
        for word in words[at : at + size]:
            new = [0]
            for k, own in enumerate(template):
                new.append(max(new[-1], row[k + 1], row[k] + (own == word)))
            row = new
        best = max(best, row[-1])
    return best / len(template)


def edited_licence(rng, words, must, edits):
    """The words with some replaced, left out or added, but for those of the mandatory phrase."""
    out, at = [], set(rng.sample([k for k in range(len(words)) if k not in must], edits))
    inside = range(min(must), max(must))
    for k, word in enumerate(words):
        kind = rng.randrange(3) if k in at else 3
        if kind != 1:
            out.append("other" if kind == 0 else word)
        if kind == 2 and k not in inside:
            out.append(f"x{rng.randrange(9)}")
    return out


def test_licence_labels_against_edits_of_templates(spark):
    """The measure is a plain alignment with the templates: near ones have their label, and no label is far from all its templates."""
    rng = random.Random(13)
    templates = license_scan.template_words()
    texts, due = [r[1] for r in odd_rows() if r[0] != 8], {}
    for label, words, must in templates * 3:
        # A word in twelve differs; short notices, where a word is much of the whole, stand as they are.
        body = edited_licence(rng, words, must, len(words) // 12)
        due[len(texts)] = label
        texts.append(" ".join([*rng.choices(PROSE.split(), k=rng.randrange(40)), *body, *rng.choices(PROSE.split(), k=rng.randrange(40))]))
    for _, words, must in templates:
        if len(words) > 12:
            texts.append(" ".join(edited_licence(rng, words, must, (len(words) - len(must)) * 4 // 5)))
    texts += ["word the of"] * 30
    found = {r["doc_id"]: set(r["labels"].split(",")) - {""} for r in license_scan.scan(documents(spark, [(k, t, "en", "a", 1) for k, t in enumerate(texts)])).collect()}
    assert [k for k, label in due.items() if label not in found[k]] == []
    own = {k: plain_words(t) for k, t in enumerate(texts)}
    for k, labels in found.items():
        for label in labels - {name for _, name in license_scan.BASE_PHRASES}:
            assert max(plain_share(words, own[k]) for name, words, _ in templates if name == label) >= 0.5, (label, texts[k])
    assert all(r == set() for k, r in found.items() if texts[k] == "word the of")


def test_licences_in_other_wordings(spark):
    texts = {
        "isc": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies.",
        "mit": "Licensed under the terms of the MIT License",
        "mit ": "This project uses the MIT License.",
        "apache-2.0": "// SPDX-License-Identifier: Apache-2.0",
        "bsd": "Redistribution and use in source and binary forms, with or without any modification, are permitted provided that the following conditions are met",
        "": "The MIT press gave a license to print; the software, version 2, was released under another one",
    }
    rows_ = [(k, t, "en", "a", 1) for k, t in enumerate(texts.values())] + [(100 + k, f"{PROSE} file {k}", "en", "a", 1) for k in range(40)]
    found = {r["doc_id"]: r["labels"] for r in license_scan.scan(documents(spark, rows_)).collect()}
    assert [found[k] for k in range(len(texts))] == [name.strip() for name in texts]


def test_words_of_equal_weight_at_the_cut_are_taken_by_name():
    words = "delta alpha charlie bravo alpha echo".split()
    assert license_scan.rare_words(words, dict.fromkeys(words, 1.0)) == {"alpha", "bravo", "charlie"}
    for _, own, _ in license_scan.template_words():
        weight = {w: 1.0 + len(w) / 10 for w in own}
        total, rare = sum(weight[w] for w in own), license_scan.rare_words(own, weight)
        one = max(weight[w] * own.count(w) for w in rare)
        assert rare == set(own) or sum(weight[w] for w in own if w in rare) - one > (1 - license_scan.LEAST_SHARE) * total


@pytest.mark.parametrize("with_it, of", [(10, 11), (11, 11), (1, 400)])
def test_label_of_a_licence_however_common(spark, with_it, of):
    notices = ["This is licensed under the MIT license.", "Licensed under the Apache License, Version 2.0."]
    texts = [f"file {k} {notices[k % 2]}" if k < with_it else f"file {k}, a license of its own" for k in range(of)]
    found = license_scan.scan(documents(spark, [(k, t, "en", "a", 1) for k, t in enumerate(texts)])).collect()
    assert {r["doc_id"]: r["labels"] for r in found} == {k: ["mit", "apache-2.0"][k % 2] if k < with_it else "" for k in range(of)}


def test_mined_rules_do_not_repeat_the_fixed_ones(spark):
    urls = [f"http://s{k % 9}.net/{['es', 'fr'][k % 2]}/{['ads', 'x'][k % 4 == 0]}" for k in range(40)]
    urls += [f"http://s{k % 9}.com/it/x" for k in range(40)]
    others = {"http://s1.net/de/x": "allow", "http://a.org/en/x": "allow", "http://a.org/de/ads": "block"}
    pages = spark.createDataFrame([(k, u) for k, u in enumerate([*urls, *others])], "page_id long, url string")
    found = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages).collect()}
    assert [found[len(urls) + k] for k in range(len(others))] == list(others.values())
