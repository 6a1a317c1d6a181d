"""Every core query against its SQL, and a stable non-empty result for those without."""

from __future__ import annotations

import pytest
from helpers import DATA, same_rows

from strandframe.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    at = f"{DATA}/sf0.001"
    same_rows(QUERIES[name](spark, at), ORACLES[name], at)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_has_rows(spark, name):
    assert QUERIES[name](spark, f"{DATA}/sf0.001").count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
