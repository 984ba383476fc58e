"""The joins of all customers with all orders leave no key of either table out."""

from quern import queries as engine
from quern.sources import catalog as C

SF = "/root/testdata/sf0.001"


def test_every_key_reaches_the_joins(spark):
    run = lambda name: engine.QUERIES[name](spark, SF)
    keys = lambda df, k: {r[0] for r in df.select(k).distinct().collect()} - {None}
    customers, orders = keys(C.load(spark, SF, "customer"), "c_custkey"), keys(C.load(spark, SF, "orders"), "o_orderkey")
    assert keys(run("j3_full_join"), "c_custkey") == keys(run("j3_left_join"), "c_custkey") == customers
    assert keys(run("j3_full_join"), "o_orderkey") == keys(run("j3_right_join"), "o_orderkey") == orders
    for side, key, every in (("left", "c_custkey", customers), ("right", "o_orderkey", orders)):
        semi, anti = keys(run(f"j4_{side}_semi_join"), key), keys(run(f"j4_{side}_anti_join"), key)
        assert semi and anti and semi | anti == every and not semi & anti
    assert keys(run("j3_inner_join"), "o_orderkey") == keys(run("j4_right_semi_join"), "o_orderkey")
