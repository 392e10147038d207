"""Every registered query of the library against its SQL."""

import pytest

from portico import plans

from .compare import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, con, name):
    df = plans.QUERIES[name](spark, SF)
    if name in plans.SQL:
        assert_same(df, con, plans.SQL[name])
    else:
        assert df.count() > 0


def test_names():
    assert set(plans.SQL) <= set(plans.QUERIES)
