"""Every query with a SQL equivalent gives what DuckDB gives on the smallest tables; every other one runs."""

import math
import os

import duckdb
import pytest

from claimgraph.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = [f.removesuffix(".parquet") for f in sorted(os.listdir(SF)) if f.endswith(".parquet")] if os.path.isdir(SF) else []


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if type(v).__name__ == "Decimal":
        return float(v)
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    names = sorted(df.columns)
    rows = sorted((tuple(plain(v) for v in r) for r in df.select(names).collect()), key=str)
    if sql := catalogue.oracle_sql().get(name):
        found = duck.execute(sql)
        at = [[c[0] for c in found.description].index(n) for n in names]
        assert len(found.description) == len(names)
        assert rows == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=str)
