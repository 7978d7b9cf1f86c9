"""Every registered query against its DuckDB SQL on the small tables."""

import pytest
from oracle import differences, duck

from weir.plans import registry

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, con, name):
    got = registry.QUERIES[name](spark, SF).toArrow()
    assert differences(got, con.execute(registry.ORACLES[name]).to_arrow_table()) == []


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
