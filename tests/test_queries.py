"""Every query of the core that has SQL gives the same rows as DuckDB; the others run."""

import os

import pytest
from oracle import connection, rows

from ranklake.plans.core import CORE

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", list(CORE.plans))
def test_query(spark, con, name):
    got = CORE.plans[name](spark, SF).toPandas()
    if name not in CORE.sql:
        assert len(got.columns)
        return
    want = con.execute(CORE.sql[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
