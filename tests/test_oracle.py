"""Every registered query against its DuckDB oracle (sf0.001; the driver
runs the same comparison at sf0.01)."""

import re

import pytest

import __spark_entry__ as E
from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
SQL = E.oracle_sql()
Q = {n: q for n, q in E.queries().items() if n in SQL or n.startswith("ml_") or not (n == "pipeline" or re.match(r"op\d+_", n))}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    ok, nrows, _, msg = compare(spark, con, name, Q[name], SQL[name], SF)
    assert ok, msg


def test_every_query_has_oracle_or_is_ml():
    missing = sorted(set(Q) - set(SQL))
    assert all(n.startswith("ml_") for n in missing), missing


@pytest.mark.parametrize("name", sorted(set(Q) - set(SQL)))
def test_rows_only(spark, name):
    assert Q[name](spark, SF).count() > 0


def test_entry_smoke(spark):
    a = E.entry(spark)
    b = E.entry(spark)
    assert a.schema == b.schema
    assert a.count() > 0
