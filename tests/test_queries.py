"""Every registered query against its SQL on DuckDB; those without SQL run."""

import math
import os

import duckdb
import pytest

from sedimark.plans import registry
from sedimark.plans.base import BASE

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE:
        p = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(value(x) for x in v)
    return v


def rows(found):
    return sorted((tuple(value(v) for v in r) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = df.select(*(f"`{c}`" for c in columns)).collect()
    if name in ORACLES:
        wanted = duck.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({ORACLES[name]}) q").fetchall()
        assert rows(found) == rows(wanted)
