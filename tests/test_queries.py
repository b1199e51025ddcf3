"""Every query against its SQL in DuckDB, or for rows and schema where it has none."""

import pytest

from tests.helpers import SMALL, assert_same, duck
from tidemark.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert_same(registry.QUERIES[name](spark, SMALL).toPandas(), duck(registry.ORACLE_SQL[name], SMALL))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_runs(spark, name):
    out = registry.QUERIES[name](spark, SMALL)
    assert out.columns and out.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
