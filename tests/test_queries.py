"""Every registered query against its SQL twin; those without one must give rows."""

from __future__ import annotations

import pytest

from recallforge import catalog
from tests.compare import SF, same


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    df = catalog.queries()[name](spark, SF)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert df.schema.fields
        df.count()
    else:
        same(df, sql)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(__spark_entry__.queries())
