"""Look-ups in a history that stays where it is."""

from cuelake.operators import history, manifest

OUTPUT = history.SCHEMA


def scans_and_exchanges(node, above=()):
    """(what a leaf scans, the names of the nodes above it) for all leaves of a physical plan."""
    name = node.nodeName()
    children = [node.children().apply(k) for k in range(node.children().size())]
    if not children:
        yield node.simpleString(200), above
    for child in children:
        yield from scans_and_exchanges(child, (*above, name))


def test_the_history_is_not_shuffled(spark):
    spark.sql("DROP TABLE IF EXISTS outputs_seen")
    table = history.OutputHistory(spark, "outputs_seen", 8)
    wanted = spark.createDataFrame([("p0", "t0"), ("p9", "t9"), ("p3", "t3"), ("new", "t1")], "path string, translation_identity string")
    assert {r["cached_path"] for r in table.cached(wanted).collect()} == {None}
    rows = [(f"p{k}", f"t{k % 5}", "o", "h", "h" if k % 7 else "x", k % 4 != 3) for k in range(40)]
    for part in (rows[:20], rows[20:]):
        table.append(spark.createDataFrame(part, OUTPUT))
    again = history.OutputHistory(spark, "outputs_seen", 8)
    found = {r["path"]: r["cached_path"] for r in again.cached(wanted).collect()}
    plain = spark.createDataFrame(rows, OUTPUT)
    assert found == {r["path"]: r["cached_path"] for r in manifest.cache_lookup(wanted, plain).collect()} and found["p9"] is None and found["p0"]
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        # As at scale: no side is small enough to be sent around whole.
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = again.cached(wanted)._jdf.queryExecution().executedPlan()
        scans = [above for leaf, above in scans_and_exchanges(plan) if "outputs_seen" in leaf]
        assert len(scans) >= 2 and not [a for above in scans for a in above if "Exchange" in a]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
        spark.sql("DROP TABLE outputs_seen")
