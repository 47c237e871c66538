"""The driver's contract: names, columns and rows of the registered queries on the smallest tables."""

import os

import pytest

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    for n in ("p1_found", "p2_rolling", "p3_found", "p4_found", "p7_found"):
        assert n in e.queries()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize(("name", "columns"), [("p1_found", ["col", "kind", "ref"]), ("p3_found", ["col", "key_value"]), ("p4_found", ["row_id", "col"]), ("p7_found", ["row_id", "kind"])])
def test_columns(spark, name, columns):
    import __spark_entry__ as e

    assert e.queries()[name](spark, DATA).columns == columns
