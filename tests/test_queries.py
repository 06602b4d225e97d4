"""Every query of the library against its SQL, on the smallest tables."""

import pytest

from helpers import SMALL, norm
from lakewright import plans

SQL = plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, small, name):
    found = plans.queries()[name](spark, SMALL).toPandas()
    if name in SQL:
        want = duck.execute(SQL[name]).df()
        assert sorted(found.columns) == sorted(want.columns)
        assert norm(found) == norm(want)
    else:
        assert len(found)


def test_entry(spark, small):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(plans.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
