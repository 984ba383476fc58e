"""Plans that queries must keep: pushed filters, pruned columns, no needless shuffle."""

import re

from quern import queries as engine

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return engine.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(spark, "s1_scan")
    assert "GreaterThan(l_quantity,45.0)" in p and "EqualTo(l_returnfl" in p
    read = re.search(r"ReadSchema: struct<([^>]*)>", p)[1]
    assert {c.split(":")[0] for c in read.split(",")} == {"l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"}
    assert "Exchange" not in p


def test_point_get_is_pushed(spark):
    assert "EqualTo(o_orderkey,7)" in plan(spark, "s6_point_get")


def test_top_k_keeps_few_rows(spark):
    assert "TakeOrderedAndProject" in plan(spark, "o8_top_k")


def test_equality_joins_are_not_nested_loops(spark):
    for name in ("j3_inner_join", "j3_full_join", "j7_expression_join", "j11_prejoin", "m1_fuse", "j8_many_tables"):
        assert not re.search("CartesianProduct|NestedLoop", plan(spark, name)), name


def test_folding_changes_has_a_partial_aggregate(spark):
    p = plan(spark, "m4_merge_increments")
    assert len(re.findall(r"(?:Sort|ObjectHash|Hash)Aggregate", p)) >= 2 and p.count("Exchange hashpartitioning") == 1


def test_scalar_functions_stay_in_the_jvm(spark):
    for name in engine.QUERIES:
        if name.startswith(("f", "pred_")):
            assert not re.search("Python|Arrow|Pandas", plan(spark, name)), name


def test_base_is_not_shuffled_for_few_changes(spark):
    from pyspark.sql import functions as F

    from quern.operators import merge
    from quern.sources import catalog as C

    base = C.load(spark, SF, "orders").select("o_orderkey", "o_custkey")
    few = spark.createDataFrame([(7, 1, 1, 1, "upsert", ["o_custkey"])], "o_orderkey long, o_custkey long, _version long, _seq long, _op string, _set array<string>")
    out = merge.fuse(base, few, ["o_orderkey"])
    out.filter(F.col("o_orderkey") < 0).collect()
    fused = merge.fuse(base, few, ["o_orderkey"])
    fused.write.format("noop").mode("overwrite").save()
    final = fused._jdf.queryExecution().executedPlan()
    assert "FullOuter" not in final.toString() and "BroadcastHashJoin" in fused._jdf.queryExecution().optimizedPlan().toString() + final.toString()
