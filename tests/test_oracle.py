"""Each query and its SQL give the same rows."""

import pytest

from siftstream import catalog


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns) and len(a) == len(b)
    cols = sorted(a.columns)
    rows = [x[cols].astype(str).replace({"None": "~", "nan": "~", "<NA>": "~"}).sort_values(cols).reset_index(drop=True) for x in (a, b)]
    assert rows[0].equals(rows[1])


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, sf_dir, name):
    same(catalog.queries()[name](spark, sf_dir).toPandas(), duck.sql(catalog.oracle_sql()[name]).df())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 50
