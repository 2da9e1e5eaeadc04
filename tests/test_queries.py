"""Every registered query against its SQL check, over whole tables."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import connect, difference, spark_rows, sql_rows
from tests.conftest import SF_DIR

QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_entry_has_rows(spark):
    assert entry(spark).columns == ["host", "snapshot_id", "ts", "keep", "reasons"]
    assert entry(spark).count() > 0


def test_every_check_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    columns, rows = spark_rows(QUERIES[name](spark, SF_DIR))
    sql_columns, expected = sql_rows(duck, SQL[name])
    assert columns == sql_columns
    assert rows == expected, difference(rows, expected)


def test_inventory_lists_the_table_files(spark):
    import os

    found = {r["name"]: r["bytes"] for r in QUERIES["scan_file_inventory"](spark, SF_DIR).collect()}
    assert found == {
        f.removesuffix(".parquet"): os.path.getsize(f"{SF_DIR}/{f}") for f in os.listdir(SF_DIR)
    }
