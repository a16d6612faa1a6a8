"""Every registered query with a SQL twin gives the same values as DuckDB on the same tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import connect, difference

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_values(spark, duck, name):
    mine = QUERIES[name](spark, SF_DIR).toPandas()
    assert difference(mine, duck.execute(ORACLES[name]).df()) is None


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", ["m4_boosted_residual_model", "m16_batch_scoring", "c10_combined_payload"])
def test_queries_without_sql_return_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
