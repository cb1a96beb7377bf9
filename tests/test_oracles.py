"""Every registered query with SQL gives the rows that DuckDB gives; the others run and have rows."""

from __future__ import annotations

import pytest
from tests.conftest import SMALL, rows

from fathomline.plans import registry


@pytest.mark.parametrize("name", registry.ORACLES)
def test_matches_sql(spark, duck, name):
    found = registry.QUERIES[name](spark, SMALL)
    expected = duck.sql(registry.ORACLES[name])
    kinds = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    assert {c: kinds[t] for c, t in found.dtypes} == dict(zip(expected.columns, map(str, expected.types), strict=True))
    assert rows(found.toPandas()) == rows(expected.df())


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in registry.ORACLES])
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SMALL).count() > 0
