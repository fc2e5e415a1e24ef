"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_registries_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 4


def test_flagship_goldens(spark):
    rows = {(r.label, r.noise_pool): r.n_windows for r in entry.entry(spark).collect()}
    assert rows == {("background", None): 661, ("background", "error"): 381, ("background", "signup"): 279, ("bell", None): 1321}


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in entry.oracle_sql()])
def test_query_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0
