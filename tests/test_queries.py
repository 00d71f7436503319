"""A cross-section of registered queries against their SQL twins (all of them: check_queries.py)."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_queries import TABLES, rows_of
from feedfold.plans import catalog

SF = "/root/testdata/sf0.001"
SAMPLE = ("entry_extract", "rejected_records", "review_upsert", "duplicate_text", "run_app_stats", "training_view",
          "review_features", "window_changes", "stratified_core", "recheck_kappa")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    result = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())


def test_catalog_is_complete(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) == set(catalog.ORACLE)
    counts = {r.rating: r.review_count for r in entry.entry(spark).collect()}
    assert set(counts) == {1, 2, 3, 4, 5}
