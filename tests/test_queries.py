"""Every timeline query against its SQL, over the small tables."""

import pytest

from evtrace.queries import oracle_sql, queries

from .compare import connect, rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_as_sql(spark, name):
    got = queries()[name](spark, SF).toPandas()
    want = connect(SF).sql(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
