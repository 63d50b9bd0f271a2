"""Every query of the core against its SQL on the smallest tables."""

import pytest

from framewright.plans import catalogue
from tests.compare import compare

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_matches_sql(spark, name):
    ok, what = compare(spark, catalogue.QUERIES[name], catalogue.SQL[name], SMALL)
    assert ok, what


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
