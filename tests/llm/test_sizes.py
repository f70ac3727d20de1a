"""Results that don't depend on the size of the input or of a basket."""

from itertools import combinations

from cuelake.llm import lm_score, url_filter

SF = "/root/testdata/sf0.001"


def test_base_scores_are_the_same_however_words_are_divided(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(300).cache()
    found = []
    for heavy in (0, 50, 10**6):
        model = lm_score.fit(docs.where("doc_id % 3 > 0"), most_heavy=heavy)
        found.append({r["doc_id"]: (r["n_known"], r["base_score"]) for r in lm_score.score(docs, model, carry=["doc_id"]).collect()})
    assert found[0] == found[1] == found[2] and len(found[0]) > 100


def test_least_count_rises_evenly_with_the_corpus(spark, monkeypatch):
    """No size at which one limit takes over from another."""
    docs = spark.createDataFrame([("ab cd",)] * 30, "text string")
    seen, asked = 30 * 7, []
    monkeypatch.setattr(lm_score, "retained_contexts", lambda *a: asked.append(a[4]))
    monkeypatch.setattr(lm_score, "SuffixTree", lambda *a: None)
    for share in (0.5 / seen, 1.5 / seen, 6.5 / seen, 20.5 / seen):
        monkeypatch.setattr(lm_score, "LEAST_SHARE", share)
        lm_score.fit(docs, least_count=8)
    assert asked == [8, 9, 14, 28]


def test_rules_of_items_beyond_the_basket(spark):
    """x and y block together; they come after more items than FP-growth gets of a basket."""
    baskets = []
    for k in range(120):
        own = [f"n{j}" for j in range(15) if k % (j + 2)] + [t for t, at in (("x", 1), ("y", 2), ("z", 3)) if k // 5 >> at & 1 or k % 11 == at]
        baskets.append((k, own, "block" if {"x", "y"} <= set(own) or k % 17 == 0 else "allow"))
    rules = url_filter.mine(spark.createDataFrame(baskets, "row long, items array<string>, verdict string"), support=0.1, confidence=0.8)
    found = {frozenset(r["tokens"]): round(r["confidence"], 6) for r in rules.collect()}
    seen = [(frozenset(t), v == "block") for _, t, v in baskets]
    sure = {}
    for size in range(1, url_filter.LONGEST + 1):
        for tokens in map(frozenset, combinations(sorted({t for s, _ in seen for t in s}), size)):
            said = [v for s, v in seen if tokens <= s]
            if sum(said) >= 0.1 * len(seen) and sum(said) >= 0.8 * len(said):
                sure[tokens] = sum(said) / len(said)
    assert max(len(t) for _, t, _ in baskets) > url_filter.BASKET and frozenset("xy") in sure
    assert found == {t: round(s, 6) for t, s in sure.items() if not any(o < t and sure[o] >= s for o in sure)}
