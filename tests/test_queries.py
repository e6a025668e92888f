"""Every registered query against its SQL, and the coverage of the registry."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from flowspark.workloads import ORACLES, QUERIES
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def connection():
    return connect("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, tables, connection, name):
    assert compare(spark, connection, QUERIES[name], ORACLES[name], tables) > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql())


def test_comparison_sees_differences(spark, tables, connection):
    run = QUERIES["for_tenant"]
    for change in ("SELECT id, payload_size + 1 AS payload_size", "SELECT id, payload_size::INTEGER AS payload_size",
                   "SELECT id, payload_size AS size", "SELECT DISTINCT 'msg-1' AS id, payload_size"):
        sql = ORACLES["for_tenant"].replace("SELECT id, payload_size FROM", f"{change} FROM")
        assert sql != ORACLES["for_tenant"]
        with pytest.raises(AssertionError):
            compare(spark, connection, run, sql, tables)


def test_flagship(spark):
    rows = entry(spark).collect()
    assert {row["route"] for row in rows} == {"express", "priority", "archive", "standard"}
