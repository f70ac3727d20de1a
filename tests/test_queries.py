"""Every registered core query against its DuckDB twin at the smallest scale."""

import duckdb
import pytest

from cuelake.plans.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


def rows_of(frame, columns):
    return sorted(map(repr, zip(*(frame[c].astype(object).where(frame[c].notna(), None).tolist() for c in columns), strict=True)))


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, name):
    ours = QUERIES[name](spark, FOLDER).toPandas()
    theirs = duck.execute(SQL[name]).fetch_df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    assert len(ours)
    assert rows_of(ours, columns) == rows_of(theirs, columns)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_whole_texts_are_filtered_and_looked_up(spark, tmp_path):
    early, late = "x" * 60, "x" * 60 + "\nThank you for watching!"
    docs = spark.createDataFrame([(2, early), (4, late), (7, late)], "doc_id long, text string")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    found = QUERIES["hallucination_filter_lines"](spark, f"file://{tmp_path}").where("by_conservative").select("doc_id", "line")
    assert sorted(map(tuple, found.collect())) == [(4, 2), (7, 2)]
    cached = QUERIES["cache_lookup_texts"](spark, f"file://{tmp_path}").collect()
    assert {r["path"]: r["cached_path"] for r in cached} == {"2": None, "4": None, "7": "4"}
