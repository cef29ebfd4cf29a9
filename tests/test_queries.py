"""Every registered query of the engine against its SQL, or for rows where there is none."""

from __future__ import annotations

import pytest

from tests.oracle import compare
from tidemark.plans.registry import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf, name):
    compare(spark, QUERIES[name], SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
