"""Every core query runs; those with SQL equal it."""

import pytest
from oracle import connect, same

from auralake.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, data, name):
    df = catalogue.QUERIES[name](spark, data)
    assert len(set(df.columns)) == len(df.columns)
    if name in catalogue.ORACLE:
        same(df, connect(data), catalogue.ORACLE[name])
    else:
        df.count()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
