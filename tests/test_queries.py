"""Every registered query of the library against its SQL."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from tests.oracle import compare

REGISTERED, ORACLES = contract._registered()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    assert compare(REGISTERED[name](spark, sf_dir), ORACLES[name], sf_dir) == ""


@pytest.mark.parametrize("name", sorted(set(REGISTERED) - set(ORACLES)))
def test_query_runs(spark, sf_dir, name):
    assert REGISTERED[name](spark, sf_dir).count() > 0


def test_entry_gives_rows(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) == 4 and all(-1 <= r.c_dir_mean <= 1 for r in rows)


def test_contract_lists_match():
    assert set(contract.oracle_sql()) <= set(contract.queries())
