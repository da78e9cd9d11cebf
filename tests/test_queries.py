"""Every query with SQL against DuckDB; the others run and give rows."""

from __future__ import annotations

import pytest

from curation.plans.registry import ORACLES, QUERIES
from tests.compare import DATA, check


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    check(spark, QUERIES, ORACLES, name)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
