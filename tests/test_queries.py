"""Every core query that has SQL gives the rows of its SQL; the others give a stable schema and rows."""

import pytest
from compare import differences

from reactionloom.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(name, spark, duck, data):
    assert not differences(registry.QUERIES[name](spark, data), duck, registry.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_query_without_sql_runs(name, spark, data):
    df = registry.QUERIES[name](spark, data)
    assert len(set(df.columns)) == len(df.columns)
    assert df.count() > 0
