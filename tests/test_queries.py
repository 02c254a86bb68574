"""Every query with a DuckDB twin against it, as the driver compares them."""

import pytest

from kinelane.queries import all_queries
from oracle import compare, connect

FOUND = all_queries()
SLOW = {"forest_rows", "forest_segments", "forest_grid", "cluster", "stored_forest", "window_multiclass"}


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", [n for n in FOUND if n not in SLOW])
def test_query(spark, data, con, name):
    assert compare(spark, data, FOUND[name], con) == ""


def test_entry_points(spark):
    import __spark_entry__ as driver

    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert driver.entry(spark).columns[:2] == ["series_id", "seq"]
