"""Every named query against its SQL twin, on the smallest test tables."""

import pytest
from compare import connect, differences

from __spark_entry__ import entry, oracle_sql, queries
from depotflow.catalog import QUERIES
from oracle.twins import TWINS

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(TWINS)
    assert QUERIES.items() <= queries().items() and TWINS.items() <= oracle_sql().items()


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_twin(spark, con, name):
    assert differences(QUERIES[name](spark, FOLDER), con, TWINS[name]) == []
