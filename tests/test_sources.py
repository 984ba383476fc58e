"""Delimited files that are not as they should be, import jobs, and the infix language."""

import pytest
from pyspark.sql import functions as F

from quern.plans.infix import infix
from quern.plans.scan import scan
from quern.sources import catalog as C
from quern.sources.importer import jobs, load_files
from quern.sources.store import Store

T = C.Table("t", (("k", "int"), ("v", "int"), ("w", "varchar(9)")), ("k",))


def lines(spark, path, *texts):
    spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1).write.text(path)
    return path


def test_bad_records(spark, tmp_path):
    path = lines(spark, str(tmp_path / "in"), "1|2|a", "x|2|a", "3|y|a", "4|5", "5|6|b|c", "|7|a", "8|\\N|\\N")
    rows = C.read_delimited(spark, path, T, sep="|", keep_bad=True)
    assert sorted((tuple(r) for r in rows.filter("_bad IS NULL").drop("_bad").collect()), key=repr) == [(1, 2, "a"), (8, None, None)]
    assert sorted(r["value"] for r in C.rejected(rows).collect()) == ["3|y|a", "4|5", "5|6|b|c", "x|2|a", "|7|a"]
    with pytest.raises(Exception, match="not a record of t"):
        C.read_delimited(spark, path, T, sep="|").collect()
    titled = lines(spark, str(tmp_path / "titled"), "k|v|w", "1|2|a")
    assert C.read_delimited(spark, titled, T, sep="|", title=True).count() == 1


def test_separators_in_values(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, "a|b\nc\\s\\\\n"), (2, None, "\\N"), (3, None, None)], "k long, v long, w string")
    with pytest.raises(Exception, match="separator in a value"):
        C.write_delimited(df, str(tmp_path / "plain"), sep="|")
    C.write_delimited(df, str(tmp_path / "out"), sep="|", escaped=True)
    back = C.read_delimited(spark, str(tmp_path / "out"), T, sep="|", escaped=True)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_import_jobs(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    state = store.state()
    store.commit({**state, "tables": {"t": Store.entry(T)}})
    path = lines(spark, str(tmp_path / "in"), "1,2,a", "2,z,b")
    text = f"[t]\ndata = {path}\ndelimiter = ,\n"
    assert jobs(text)["t"]["delimiter"] == ","
    assert load_files(store, text) == {"t": (1, 1)}
    assert [tuple(r) for r in store.read(store.state(), "t").collect()] == [(1, 2, "a")]
    with pytest.raises(ValueError):
        load_files(store, text.replace("[t]", "[u]"))


def test_infix(spark):
    df = spark.createDataFrame([(1, 2.0, "abc"), (None, 0.0, None)], "a int, b double, s string")
    one = lambda e: [r[0] for r in df.select(infix(e)).collect()]
    assert one("`a` + 2 * 3") == [7, None] and one("-(`a` - 3) / 2") == [1.0, None] and one("`a` % 2") == [1, None]
    assert one("`s` like 'b' and not `b` > 2") == [True, None] and one("`a` is null or `b` <> 2") == [False, True] and one("`s` is not null") == [True, False]
    for bad in ("a + 1", "`a` +", "upper(`s`)", "`a` between 1 and 2", "1; drop", "(`a`"):
        with pytest.raises(ValueError):
            infix(bad)
    assert scan(df).infix(x="`a` + 1").where_infix("`b` > 1").run().collect()[0]["x"] == 2


def test_first_of_group_needs_an_order(spark):
    from quern.operators.relational import group

    with pytest.raises(ValueError):
        group(spark.range(3), [], {"n": F.count("*")}, first=["id"])
