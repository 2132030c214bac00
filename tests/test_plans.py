"""Every query with SQL gives DuckDB's rows."""

import os

import duckdb
import pandas as pd
import pytest

from credence import plans

DATA = "/root/testdata/sf0.01"  # the smallest tables have too few sessions to tell some constants apart
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
plans.load_all()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if pd.api.types.is_scalar(v) and pd.isna(v):
            return "null"
        if hasattr(v, "year"):
            return str(v)[:10] if str(v)[10:] in ("", " 00:00:00") else str(v)
        if isinstance(v, (int, float)) and not isinstance(v, bool) or getattr(getattr(v, "dtype", None), "kind", "") in ("i", "u", "f"):
            return f"{float(v):.7g}"
        return str(v)

    return sorted(tuple(one(v) for v in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_sql(spark, duck, name):
    assert plain(plans.QUERIES[name](spark, DATA).toPandas()) == plain(duck.sql(plans.SQL[name]).df())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_the_rest_without_the_subpackage():
    import ast
    import pathlib

    root = pathlib.Path(plans.__file__).resolve().parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [a.name for a in node.names] if isinstance(node, (ast.Import, ast.ImportFrom)) else []
                module = getattr(node, "module", "") or ""
                assert not any("llm" in x.split(".") for x in [*names, module]), path
