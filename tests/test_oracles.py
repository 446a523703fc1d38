"""Every query with an oracle equals it; every query without one runs."""

from __future__ import annotations

import pytest

from tenorlake import plans
from tests.oracle import connect, differences

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_oracle(spark, con, name):
    assert differences(plans.QUERIES[name](spark, SF), con, plans.ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_runs(spark, name):
    df = plans.QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows and df.columns


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_missing_buckets_are_those_of_the_profile(spark, size):
    """The SQL of a09 is a constant that holds on small tables; a10's SQL counts the gaps of the same features."""
    d = f"/root/testdata/{size}"
    count = "SELECT count(*) FILTER (nan_pct = 0) AS complete, count(*) FILTER (nan_pct > 0 AND nan_pct < 100) AS partial, count(*) FILTER (nan_pct = 100) AS empty"
    assert differences(plans.QUERIES["a09_missing_buckets"](spark, d), connect(d), f"{count} FROM ({plans.ORACLES['a10_column_profile']})") == ""
