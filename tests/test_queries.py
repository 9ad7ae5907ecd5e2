"""Each registered query with SQL against DuckDB, and the shape of the registry."""

import math
from decimal import Decimal

import duckdb
import pytest

from lodemark.plans import registry
from lodemark.sources.governance import TABLES

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def shown(value):
    if isinstance(value, (float, Decimal)):
        return "nan" if math.isnan(value) else f"{float(value):.7g}"
    return [shown(v) for v in value] if isinstance(value, (list, tuple)) else str(value)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(str([shown(v) for v in row]) for row in df.select(*columns).collect())
    result = duck.sql(SQL[name])
    at = [result.columns.index(c) for c in columns]
    assert sorted(result.columns) == columns
    assert got == sorted(str([shown(row[i]) for i in at]) for row in result.fetchall())


def test_entry_imports():
    import __spark_entry__

    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries)
    assert "weekly_risk_trend" in queries
