"""Every registered query against its DuckDB SQL on the smallest data."""

import sys

import pytest

sys.path.insert(0, "tools")
import __spark_entry__ as contract  # noqa: E402
from tools.check_oracles import compare, connect  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_only_known_queries_have_sql():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", list(contract.queries()))
def test_query(spark, con, name):
    if name not in contract.oracle_sql():
        assert contract.queries()[name](spark, SF).count() >= 0
        return
    got, want = compare(spark, con, name, SF)
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_entry(spark):
    assert contract.entry(spark).limit(1).count() == 1
