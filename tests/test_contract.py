"""Every registered query beside its SQL on the smallest tables."""

import pytest

from pairlens.contract import load
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in ORACLES:
        assert compare(spark, con, SF, QUERIES[name], ORACLES[name]) is None
    else:
        assert QUERIES[name](spark, SF).columns
        assert QUERIES[name](spark, SF).count() >= 0
