"""Every query against its SQL on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_module
from seriesweave.catalog.oracle import ORACLE
from seriesweave.catalog.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("events", "customer"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry_module.queries()) and set(ORACLE) <= set(entry_module.oracle_sql())


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF_DIR)
    columns = sorted(frame.columns)
    expected = duck.sql(ORACLE[name])
    assert sorted(expected.columns) == columns
    places = [expected.columns.index(c) for c in columns]
    want = Counter(tuple(r[i] for i in places) for r in expected.fetchall())
    have = Counter(tuple(r) for r in frame.select(*(f"`{c}`" for c in columns)).collect())
    assert sum(have.values()) > 0
    assert have == want


def test_entry(spark):
    assert entry_module.entry(spark).columns[0] == "series_id"


@pytest.mark.parametrize(
    "name", ["statistics_from_dictionaries", "last_reset_rows_text_both", "replace_series_target_rows_both", "replace_series_both_tables", "splice_text_marks", "statistics_resets_text"]
)
def test_stored_tables_of_both_grains(spark, name):
    tables = {r["table"] for r in QUERIES[name](spark, SF_DIR).select("table").distinct().collect()}
    assert tables == {"statistics", "statistics_short_term"}
