"""Joins, set operations, limits, lookups, merge on read, snapshots, sessions and replay on small inline tables."""

import pytest
from pyspark.sql import functions as F

from quern.operators import dml, merge
from quern.operators.prejoin import prejoin, timed_prejoin
from quern.operators.relational import group, join, limit, set_operation, sort
from quern.plans.scan import scan
from quern.plans.session import Session
from quern.sources import catalog as C
from quern.streaming import changelog


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def ab(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (None, "n")], "k int, s string")
    b = spark.createDataFrame([(1, "x"), (3, "z"), (None, "n"), (None, "n")], "k int, s string")
    return a, b


def test_joins(ab):
    a, b = ab
    count = lambda how: join(a, b.select("k"), ["k"], how).count()
    assert [count(h) for h in ("inner", "left", "right", "full", "left_semi", "right_semi", "left_anti", "right_anti")] == [2, 4, 5, 7, 2, 1, 2, 3]
    with pytest.raises(ValueError):
        join(a, b, ["k"], "cross")


def test_set_operations(ab):
    a, b = ab
    get = lambda kind, every: rows(set_operation(kind, a, b, every=every))
    assert get("intersect", False) == rows(a.sparkSession.createDataFrame([(1, "x"), (None, "n")], a.schema))
    assert len(get("intersect", True)) == 2 and len(get("union", True)) == 8 and len(get("union", False)) == 4
    assert get("except", True) == [(1, "x"), (2, None)] and get("except", False) == [(2, None)]
    with pytest.raises(ValueError):
        set_operation("union", a, b.select("k"))


def test_sort_and_limit(ab):
    a, _ = ab
    assert sort(a, 1).first()["k"] is None and sort(a, -1).first()["k"] == 2
    assert limit(a, -1).count() == 4 and limit(sort(a, 1), None, 3).count() == 1 and limit(a, 0).count() == 0
    for bad in (lambda: limit(a, -2), lambda: limit(a, 1, -1), lambda: sort(a, 0), lambda: sort(a, 3)):
        with pytest.raises(ValueError):
            bad()


def test_scalar_aggregate_of_nothing(ab):
    out = group(ab[0].filter("k > 9"), [], {"n": F.count("*"), "s": F.sum("k")})
    assert rows(out) == [(0, None)]


def test_prejoin(spark):
    look = C.parse_join_info("[a$k]%t2:v$v,w$x")
    left = spark.createDataFrame([(1, "old"), (9, "old"), (None, "old")], "a int, v string")
    right = spark.createDataFrame([(1, "new", 5)], "k int, v string, x int")
    assert rows(prejoin(left, right, look, ["k"])) == rows(spark.createDataFrame([(1, "new", 5), (9, None, None), (None, None, None)], "a int, v string, w int"))
    with pytest.raises(ValueError):
        prejoin(left, right, look, ["k", "x"])
    with pytest.raises(ValueError):
        C.parse_join_info("a$k%t2")


def test_timed_prejoin(spark):
    left = spark.createDataFrame([(1, 5, 5), (2, None, 5), (3, 5, 5)], "k int, made int, changed int")
    right = spark.createDataFrame([(1, 3, 9, "a"), (2, 3, 4, "b")], "k int, made int, changed int, v string")
    out = timed_prejoin(left, right, ["k"], created="made", modified="changed", columns=["v"])
    assert rows(out) == [(1, 3, 9, "a"), (2, None, 5, "b"), (3, 5, 5, None)]


CHANGE = "k int, v int, w int, _version long, _seq long, _op string, _set array<string>"


@pytest.fixture(scope="module")
def base(spark):
    return spark.createDataFrame([(i, i * 10, i * 100) for i in range(1, 7)], "k int, v int, w int")


def test_fuse(spark, base):
    changes = spark.createDataFrame(
        [
            (1, 11, None, 1, 1, "upsert", ["v"]),  # w is unchanged
            (2, None, None, 1, 2, "upsert", ["v"]),  # v is set to NULL
            (3, None, None, 1, 3, "delete", []),
            (4, None, None, 1, 4, "delete", []),
            (4, 44, None, 1, 5, "upsert", ["v"]),  # w does not come back
            (5, 55, None, 1, 6, "upsert", ["v"]),
            (5, None, None, 2, 1, "delete", []),
            (8, None, 8, 1, 7, "upsert", ["w"]),
            (9, None, None, 1, 8, "delete", []),
            (1, 12, None, 2, 2, "upsert", ["v"]),
        ],
        CHANGE,
    )
    assert rows(merge.fuse(base, changes, ["k"])) == rows(spark.createDataFrame([(1, 12, 100), (2, None, 200), (4, 44, None), (6, 60, 600), (8, None, 8)], base.schema))
    at1 = {r[0]: r[1] for r in rows(merge.fuse(base, changes, ["k"], upto=1))}
    assert at1[1] == 11 and at1[5] == 55
    new, rest = merge.compact(base, changes, ["k"], 1, "v > 50")
    assert {r[0] for r in rows(new)} == {1, 2, 4, 8} and rest.count() == 2
    assert rows(merge.read(base, changes, ["k"], static=True)) == rows(base)


def test_fuse_of_nothing(spark, base):
    none = spark.createDataFrame([], CHANGE)
    assert rows(merge.fuse(base, none, ["k"])) == rows(base)
    assert merge.fuse(base.limit(0), none, ["k"]).count() == 0


T = C.Table("t", (("k", "int"), ("v", "int"), ("w", "varchar(9)")), ("k",))


def test_insert_update_delete(spark):
    now = spark.createDataFrame([(1, 1, "a"), (2, None, "b")], T.schema)
    more = spark.createDataFrame([(3, 3)], "k long, v long")
    assert rows(dml.insert(now, more, T).rows) == [(1, 1, "a"), (2, None, "b"), (3, 3, None)]
    with pytest.raises(dml.KeyExists):
        dml.insert(now, spark.createDataFrame([(2, 3)], "k long, v long"), T)
    with pytest.raises(dml.KeyExists):
        dml.insert(now, spark.createDataFrame([(5, 3), (5, 4)], "k long, v long"), T)
    with pytest.raises(ValueError):
        dml.insert(now, more, T, ["k", "k"])
    assert rows(dml.insert_new(now, spark.createDataFrame([(2, 3), (7, 7)], "k long, v long"), T).rows) == rows(now)
    assert rows(dml.replace(now, spark.createDataFrame([(2, 9)], "k long, v long"), T).rows) == [(1, 1, "a"), (2, 9, None)]
    assert rows(dml.update(now, {"v": F.col("v") + 1}, "v > 0", T).rows) == [(1, 2, "a"), (2, None, "b")]
    assert rows(dml.delete(now, "v > 0").rows) == [(2, None, "b")]
    with pytest.raises(ValueError):
        dml.update(now, {"k": F.lit(1)}, "v > 0", T)


def test_when_is_nested(spark):
    now = spark.createDataFrame([(1, 1, "a"), (2, 2, "b")], T.schema)
    inner = dml.delete(now, "k = 1")
    outer = dml.update(now, {"w": F.lit("z")}, "k = 2", T)
    assert rows(dml.when(outer, lambda n: n == 1, now, inner).rows)[1][2] == "z"
    assert rows(dml.when(outer, lambda n: n > 1, now, inner).rows) == rows(now)


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "t")
    dml.write_snapshot(spark.range(3).toDF("k"), root, 1)
    dml.write_snapshot(spark.range(5).toDF("k"), root, 2)
    assert dml.read_snapshot(spark, root).count() == 5 and dml.read_snapshot(spark, root, 1).count() == 3


def test_prejoined_columns_are_not_writable(spark):
    t = C.Table("t", (("k", "int"), ("v", "int")), ("k",), join_info="[k$a]%o:v$v")
    with pytest.raises(ValueError):
        dml.insert(spark.createDataFrame([], t.schema), spark.createDataFrame([(1, 2)], "k long, v long"), t)


def test_catalog(spark, tmp_path):
    c = C.Catalog(spark)
    spark.createDataFrame([(1, 2)], "k long, v long").write.parquet(str(tmp_path / "t"))
    c.create(C.Table("t", (("k", "int"), ("v", "int")), ("k",)), str(tmp_path / "t"))
    c.alter(c.tables["t"].add("w", "varchar(3)").rename("v", "v"))
    assert rows(c.read("t")) == [(1, 2, None)]
    with pytest.raises(ValueError):
        c.create(C.Table("t", ()))
    with pytest.raises(ValueError):
        c.tables["t"].drop("k")
    shown = Session(spark, c)
    assert shown.show("create table", "t").first()[1].startswith("CREATE TABLE t (k int, v int, w varchar(3), PRIMARY KEY (k))")
    assert shown.show("columns", "t", "v%").count() == 1
    c.drop("t")
    assert c.all_tables().count() == 0
    assert C.type_of("decimal(10,2)").simpleString() == "decimal(10,2)" and C.type_of("SMALLINT").simpleString() == "bigint"


def test_nop_and_null_in_text(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([("1|-|\\N",), ("2|5|x",)], "value string").write.text(path)
    got = C.read_delimited(spark, path, T, sep="|", nop="-")
    assert rows(got) == rows(spark.createDataFrame([(1, None, None, ["k", "w"]), (2, 5, "x", ["k", "v", "w"])], "k long, v long, w string, _set array<string>"))


def test_scan_builder(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 0.0), (None, 1.0)], "g int, x double")
    out = scan(df).group_by("g", s=("sum", "x"), n=("count", "x")).ratio(a="try_divide(n, s)").having("n", "<=", 2).order_by("g").limit(2, 1).run()
    assert [tuple(r) for r in out.collect()] == [(1, 6.0, 2, 1 / 3), (2, 0.0, 1, None)]
    with pytest.raises(ValueError):
        scan(df).group_by("g", s=("avg", "x"))


def test_session(spark):
    s = Session(spark)
    s.prepare("p", "SELECT ? + ? AS x")
    s.set("@a", 2)
    s.set("b", 3)
    assert s.execute("p", ["@a", "@b"]).first()["x"] == 5
    with pytest.raises(ValueError):
        s.execute("p", ["@a"])
    s.deallocate("p")
    with pytest.raises(KeyError):
        s.execute("p")
    assert "Project" in s.explain("SELECT @a AS a")


def test_replay_resumes(spark, tmp_path):
    seen = []
    log = spark.createDataFrame([("t", 1, i, i) for i in range(40)], "table string, version long, seq long, key long")
    for part in (log.filter("seq < 20"), log.filter("seq >= 20")):
        part.write.mode("append").parquet(str(tmp_path / "in"))
        stream = changelog.partitioned(changelog.changes(spark, str(tmp_path / "in"), log.schema), "key")
        changelog.replay(stream, str(tmp_path / "at"), lambda rows, n: seen.append(rows.count()))
    assert sum(seen) == 40
    changelog.replay(stream, str(tmp_path / "at"), lambda rows, n: seen.append(rows.count()))
    assert sum(seen) == 40


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
