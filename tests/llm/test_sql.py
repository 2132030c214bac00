"""Every query of the subpackage with SQL gives DuckDB's rows."""

import os

import duckdb
import pytest

from credence.llm import queries
from tests.test_plans import TABLES, plain

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, duck, name):
    assert plain(queries.QUERIES[name](spark, DATA).toPandas()) == plain(duck.sql(queries.SQL[name]).df())
