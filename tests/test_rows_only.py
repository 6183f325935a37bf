"""Queries without an oracle (model fits) run at sf0.001 with rows and a
stable schema, as the driver's rows-only check expects."""

import pytest

from conftest import SF001
from tabtext.plans.oracle import SQL
from tabtext.plans.queries import QUERIES

ROWS_ONLY = sorted(set(QUERIES) - set(SQL))


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only_query(spark, name):
    df = QUERIES[name](spark, SF001)
    schema = df.schema
    rows = df.collect()
    from tabtext.plans.compare import NESTED_LOOP
    assert not NESTED_LOOP.search(df._jdf.queryExecution().executedPlan().toString())
    assert len(rows) > 0
    assert df.schema == schema
