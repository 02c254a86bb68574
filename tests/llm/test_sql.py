"""Operators that SQL can express against their DuckDB twins, as the driver compares them."""

import pytest
from oracle import compare, connect

from kinelane.llm.queries import QUERIES, SQL
from kinelane.queries import Query


@pytest.mark.parametrize("name", SQL)
def test_twin(spark, data, name):
    assert compare(spark, data, Query(QUERIES[name], SQL[name]), connect(data)) == ""
