"""Every registered query on the smallest tables, against its oracle SQL where it has one."""

from __future__ import annotations

import pytest
from compare import check, connect

import __spark_entry__ as entry

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
BUILT, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(BUILT))
def test_query(spark, con, name):
    if name not in ORACLES:
        assert not BUILT[name](spark, SF).isEmpty()
        return
    problem = check(spark, con, name, BUILT[name], ORACLES[name], SF)
    if problem == "no rows":
        # Too few rows to find anything here; the next scale has some.
        problem = check(spark, connect(LARGER), name, BUILT[name], ORACLES[name], LARGER)
    assert problem is None, problem


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(BUILT)
