"""Every query of the engine against its SQL on DuckDB, over the smallest tables."""

import math
import os

import duckdb
import pytest

from quern import queries as engine

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.replace(tzinfo=None) if getattr(v, "tzinfo", None) else v


@pytest.mark.parametrize("name", engine.QUERIES)
def test_query(spark, duck, name):
    df = engine.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    if name not in engine.SQL:
        assert got
        return
    answer = duck.sql(engine.SQL[name])
    assert sorted(answer.columns) == columns
    at = [answer.columns.index(c) for c in columns]
    assert got == sorted(([plain(r[i]) for i in at] for r in answer.fetchall()), key=repr)
