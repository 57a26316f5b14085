"""Every query with SQL gives the rows of its SQL."""

import pytest

from tests.conftest import SF, rows_of, sql_rows
from tidemark.queries import QUERIES


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name].run(spark, SF)
    columns, want = sql_rows(duck, QUERIES[name].sql)
    assert sorted(df.columns) == columns
    assert rows_of(df) == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
