"""Every registered query against its SQL in DuckDB, on the smallest data set."""

import pytest

from flowlens.plans.catalogue import ORACLES, QUERIES
from tools.compare import compare, oracle_connection


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle_connection(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        assert compare(df, con, ORACLES[name]) == []
    else:
        assert df.count() > 0


def test_every_query_has_sql():
    assert sorted(set(QUERIES) - set(ORACLES)) == []
