"""Every registered query against its SQL; those without SQL have to give rows."""

import pytest
from oracle import check

from gridlens.plans import PLANS


@pytest.mark.parametrize("name", sorted(PLANS))
def test_query(spark, data, name):
    plan, sql = PLANS[name]
    df = plan(spark, data)
    if sql:
        check(df, sql, data)
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 25
    assert set(entry.oracle_sql()) <= set(entry.queries())
