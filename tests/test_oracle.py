"""Every query against its SQL equivalent on the smallest test tables."""

from __future__ import annotations

import pytest

from measurelake.plans import catalog, oracle
from verify_oracle import compare, connect, run_spark, run_sql

SF = "/root/testdata/sf0.001"
@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(catalog.all_queries()) == set(oracle.all_sql())


@pytest.mark.parametrize("name", sorted(oracle.all_sql()))
def test_equals_sql(spark, con, name):
    ours = run_spark(catalog.all_queries()[name](spark, SF))
    problem = compare(ours, run_sql(con, oracle.all_sql()[name]))
    assert problem is None, problem


def test_entry(spark):
    from __spark_entry__ import entry, oracle_sql, queries

    assert entry(spark).count() == 5
    assert set(queries()) >= set(oracle_sql())
