"""Every query with reference SQL gives DuckDB's rows."""

import pytest

from loomwork import catalog
from tests.compare import duck, spark_rows

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    df = catalog.queries()[name](spark, SF)
    sql = catalog.oracle_sql().get(name)
    got = spark_rows(df)
    if sql:
        want = duck(sql, SF)
        assert got[0] == want[0]
        assert len(got[1]) == len(want[1])
        assert got[1] == want[1]
