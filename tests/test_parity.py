"""Every catalog query against its DuckDB oracle on sf0.001 (the driver uses sf0.01)."""

import pytest

import __spark_entry__ as E
from gustframe.plans import catalog
from gustframe.plans.verify import _canon, digest, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_oracle(spark, con, name):
    sdf = catalog.queries()[name](spark, SF).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(sdf.columns) > 0
        return
    ddf = con.execute(sql).df()
    assert sorted(sdf.columns) == sorted(ddf.columns)
    a, b = _canon(sdf), _canon(ddf)
    assert len(a) == len(b)
    assert digest(a) == digest(b)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
