"""Every query with SQL gives that SQL's rows; the others run."""

import pytest
from pagerefine.plans import catalog

from tests.conftest import DATA


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows_as_sql(name, same_as_sql):
    same_as_sql(catalog.QUERIES[name], catalog.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(name, spark):
    assert catalog.QUERIES[name](spark, str(DATA)).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
