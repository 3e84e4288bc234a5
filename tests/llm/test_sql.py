"""The corpus queries with SQL give the rows that DuckDB gives (smallest tables)."""

import pytest

from cellsight.llm import queries
from tests.test_queries import SF, duck, frame  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):  # noqa: F811
    want, got = duck.sql(queries.ORACLES[name]).df(), queries.QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert frame(want, columns).equals(frame(got, columns))
