"""Every query with SQL against DuckDB; every other one runs and has rows."""

import pytest

from gritmill import catalog
from tests import oracle

SF = "/root/testdata/sf0.001"
catalog.load()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, con, name):
    assert not oracle.differences(con, catalog.QUERIES[name](spark, SF), catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
