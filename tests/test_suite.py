"""Every registered entity query against its SQL."""

import pytest
from helpers import rows_of

from rowmill.plans.suite import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name not in ORACLE:
        assert len(got.columns)
        return
    want = duck.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
