"""Ordered results without a limit: all rows, in the order of their SQL."""

import duckdb
import pytest

from quern import queries as engine

SF = "/root/testdata/sf0.001"
NAMES = ("o1_sort", "s19_reverse_scan", "o5_ordinal", "o6_order_hidden", "o7_nulls_first", "o7_nulls_last", "a12_order_by_aggregate", "u9_order_by")


@pytest.mark.parametrize("name", NAMES)
def test_all_rows_in_order(spark, name):
    c = duckdb.connect()
    for t in ("orders", "nation", "region", "supplier"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.sql(engine.SQL[name]).fetchall()
    assert "LIMIT" not in engine.SQL[name]
    assert [tuple(r) for r in engine.QUERIES[name](spark, SF).collect()] == want
