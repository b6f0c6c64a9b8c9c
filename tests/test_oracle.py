"""Every query of the catalog with SQL gives the SQL's rows; the others run."""

import os

import pytest

from docuplane.plans import catalog
from tests.oracle import connect, difference

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = {k: f for m in catalog.MODULES for k, f in m.QUERIES.items()}
SQL = {k: q for m in catalog.MODULES for k, q in m.SQL.items()}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal(spark, con, name):
    assert difference(spark, con, QUERIES[name], SQL[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() > 0 and df.columns


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["doc_id", "score"]
