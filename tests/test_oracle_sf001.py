"""Every registered query with an oracle matches DuckDB (sf0.001 here; the
driver repeats this at sf0.01)."""

import pytest

from conftest import SF001
from tabtext.plans.oracle import SQL


@pytest.fixture(scope="module")
def duck001():
    from tabtext.plans.compare import duck
    return duck(SF001)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, duck001, name):
    from tabtext.plans.compare import compare
    r = compare(spark, SF001, name, duck001)
    assert r["cols_match"], r
    assert r["rows_spark"] == r["rows_oracle"], r
    assert r["values_match"], r
    assert r["types_match"], r
    assert not r["nested_loop_join"], r
