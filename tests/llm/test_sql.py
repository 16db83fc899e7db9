"""Queries with reference SQL give DuckDB's rows."""

import pytest

from loomwork.llm import queries as q
from tests.compare import duck, spark_rows

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query(spark, name):
    assert spark_rows(q.queries()[name](spark, SF)) == duck(q.oracle_sql()[name], SF)
