"""Every registered query with SQL must equal it at the smallest scale."""
import pytest
from oracle import compare, duck

from fraudloom.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


NAMES = sorted(catalogue.ORACLES)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    out = compare(spark, con, name, catalogue.QUERIES[name], catalogue.ORACLES[name], FOLDER)
    assert out.startswith("ok") and "INEXACT" not in out, out


@pytest.mark.parametrize("name", ["jn4_face_links_approx", "sc26_explanations", "ml5_keystroke_model", "ml5_sweep"])
def test_query_without_sql_runs(spark, name):
    assert name not in catalogue.ORACLES
    assert catalogue.QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
