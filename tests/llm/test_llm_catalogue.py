"""The llm queries on the smallest tables: against SQL, or that they run."""

import pytest

from framewright.llm import queries
from tests.compare import compare

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, name):
    ok, what = compare(spark, queries.QUERIES[name], queries.SQL[name], SMALL)
    assert ok, what


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SMALL).count() > 0
