"""Statements as text: changes, WHEN, transactions, declarations, hints and SHOW over a store."""

import threading

import pytest

from quern.operators.dml import KeyExists
from quern.plans import statements as st
from quern.plans.session import Session, StatementError
from quern.sources.store import ConcurrentChange, Store


@pytest.fixture
def s(spark, tmp_path):
    return Session(spark, store=Store(spark, str(tmp_path / "db")))


def rows(s, text):
    return sorted((tuple(r) for r in s.sql(text).collect()), key=repr)


def code(s, text):
    with pytest.raises(StatementError) as e:
        s.sql(text)
    return e.value.code


def n(s, text):
    return s.sql(text).first()["affected"]


def test_insert_replace_update_delete(s):
    s.sql("create table t (k int primary key, v int, w varchar(9) default 'none')")
    assert n(s, "INSERT INTO t VALUES (1, 2, 'it''s'), (3, 4, NULL);") == 2
    assert n(s, "insert into t (v, k) values (6, 5)") == 1
    assert rows(s, "select * from t") == [(1, 2, "it's"), (3, 4, None), (5, 6, "none")]
    with pytest.raises(KeyExists):
        s.sql("insert into t (k) values (9), (1)")
    with pytest.raises(KeyExists):
        s.sql("insert into t (k) values (9), (9)")
    for bad in ("insert into t (k, k) values (1, 2)", "insert into t (v) values (1)", "insert into t (k, v) values (1)", "update t set k = 2 where k = 1", "update t set v = 1, v = 2 where k = 1", "insert into x values (1)"):
        with pytest.raises(ValueError):
            s.sql(bad)
    assert n(s, "replace into t (k, v) values (1, 7), (8, 8), (8, 9)") == 2
    assert rows(s, "select * from t where k in (1, 8)") == [(1, 7, "none"), (8, 9, "none")]
    assert n(s, "update t set v = v + 1, w = 'when' where k = 3 and v = 4") == 1
    assert n(s, "update t set v = 0 where k = 3 and v = 4") == 0
    assert n(s, "delete from t where k in (5, 8, 99)") == 2
    assert rows(s, "select k, v, w from t") == [(1, 7, "none"), (3, 5, "when")]
    assert n(s, "insert into t (k, v) select k + 100, v from t where v > 5") == 1
    assert s.sql("select count(*) as n from t").first()["n"] == 3


def test_keys_must_be_given(s):
    s.sql("create table t1 (pk int, extra int, primary key (pk))")
    s.sql("insert into t1 (pk) values (NULL), (1), (2)")
    for where in ("pk != NULL", "pk is NULL", "pk is not NULL", "extra = 1", "pk > 0", "pk = 1 or pk = 2"):
        assert code(s, f"update t1 set extra = 1 where {where}") == 5047 and code(s, f"delete from t1 where {where}") == 5047
    assert n(s, "update t1 set extra = 1 where pk = NULL") == 1
    assert rows(s, "select * from t1") == [(1, None), (2, None), (None, 1)]
    assert n(s, "delete from t1 where pk = NULL") == 1 and n(s, "delete from t1 where 2 = pk") == 1
    assert rows(s, "select * from t1") == [(1, None)]


def test_when_counts_inner_changes(s):
    s.sql("create table o (a int primary key, b int)")
    s.sql("create table i (a int primary key, b int)")
    s.sql("insert into o values (1, 2), (3, 4)")
    s.sql("insert into i values (1001, 1002), (1003, 1004)")
    assert n(s, "insert into o values (4, 5), (7, 8) when row_count(update i set b = 1005 where a = 1001) = 1") == 2
    assert n(s, "insert into o values (9, 10) when row_count(insert into i values (1002, 1003), (1005, 1006)) = 1") == 0
    assert rows(s, "select a from i") == [(1001,), (1003,)]  # the inner change goes with the outer one
    assert n(s, "insert into o values (11, 12) when row_count(delete from i where a = 1) <= length('haha')") == 1
    assert n(s, "update o set b = 11 where a = 1 when row_count(insert into i values (1007, 1008)) * 100 > 0 and true") == 1
    assert n(s, "update o set b = 13 where a = 3 when row_count(delete from i where a = 1005) and 56 * length('haha') and true") == 0
    assert n(s, "insert into o values (10, 10) when row_count(update o set b = 111 where a = 1 when row_count(delete from i where a = 100) = 0) > 0") == 1
    assert n(s, "update /*+ hotspot */ o set b = case when b = 4 then 5 else 6 end where a = 3 when row_count(update o set b = 3 where a = 4) > 0") == 1
    assert rows(s, "select * from o") == [(1, 111), (10, 10), (11, 12), (3, 5), (4, 3), (7, 8)]
    assert rows(s, "select * from i") == [(1001, 1005), (1003, 1004), (1007, 1008)]


def test_transactions(s, spark):
    other = Session(spark, store=Store(spark, s.store.root))
    s.sql("create table t (k int primary key, a int)")
    s.sql("insert into t values (1, 1)")
    s.sql("begin")
    assert n(s, "update t set a = 2 where k = 1") == 1 and n(s, "update t set a = a + 1 where k = 1") == 1
    assert rows(s, "select * from t") == rows(other, "select * from t") == [(1, 1)]
    s.sql("commit")
    assert rows(s, "select * from t") == rows(other, "select * from t") == [(1, 3)]
    s.sql("start transaction")
    s.sql("insert into t values (2, 2)")
    with pytest.raises(KeyExists):
        s.sql("insert into t values (2, 3)")
    s.sql("rollback")
    assert rows(s, "select * from t") == [(1, 3)]
    s.sql("begin")
    s.sql("update t set a = 9 where k = 1")
    other.sql("update t set a = 5 where k = 1")
    with pytest.raises(ConcurrentChange):
        s.sql("commit")
    assert rows(s, "select * from t") == [(1, 5)]
    s.sql("set autocommit = 0")
    s.sql("delete from t where k = 1")
    assert rows(other, "select * from t") == [(1, 5)]
    s.sql("set autocommit = 1")
    assert rows(other, "select * from t") == []


def test_one_of_two_writers_wins(s, spark):
    s.sql("create table t (k int primary key)")
    state = s.store.state()
    won = []

    def write():
        try:
            won.append(Store(spark, s.store.root).commit(state)["version"])
        except ConcurrentChange:
            pass

    threads = [threading.Thread(target=write) for _ in range(2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert s.store.state()["version"] == state["version"] + 1


def test_declarations(s):
    s.sql("create table stu (id int primary key, name char(9))")
    s.sql("create table if not exists stu (x int primary key)")
    assert code(s, "create table stu (id int primary key)") == 5025
    s.sql("insert into stu values (1, 'a')")
    s.sql("alter table stu add c1 int, add column c2 char(90)")
    s.sql("insert into stu (id, c1) values (2, 18)")
    assert rows(s, "select * from stu") == [(1, "a", None, None), (2, None, 18, None)]
    assert code(s, "alter table stu add column c1 int") == 5008
    assert code(s, "alter table stu add column c7 int primary key") == 5057
    assert code(s, "alter table stu add column c7 createtime") == 5056
    assert code(s, "alter table stu drop id") == 5002
    assert code(s, "alter table stu add column c8 int, drop column c8") == 5008
    s.sql("alter table stu drop c1, drop column c2, add c3 int default 10")
    s.sql("alter table stu add c1 int")  # not the old column of that name
    s.sql("alter table stu rename name to label")
    s.sql("insert into stu (id) values (3)")
    assert rows(s, "select * from stu") == [(1, "a", None, None), (2, None, None, None), (3, None, 10, None)]
    assert [r["column_name"] for r in s.sql("desc stu").orderBy("position").collect()] == ["id", "label", "c3", "c1"]
    s.sql("create table times (id int primary key, made createtime, changed modifytime, v int)")
    s.sql("insert into times (id) values (1)")
    first = s.sql("select made, changed from times").first()
    s.sql("update times set v = 1 where id = 1")
    second = s.sql("select made, changed from times").first()
    assert first["made"] == second["made"] and second["changed"] > first["changed"]
    assert code(s, "alter table times drop column made") == 5056
    s.sql("drop table times, stu")
    s.sql("drop table if exists stu")
    assert code(s, "drop table stu") == 5019
    assert [(r["level"], r["code"]) for r in s.sql("show warnings").collect()] == [("Note", 5025), ("Note", 5019)]


def test_hints_choose_the_version_and_the_query_runs(s):
    s.sql("create table t (c1 int primary key, c2 int) expire_info = 'c2 < 0'")
    s.sql("insert into t values (1, 2), (3, 4), (5, -6)")
    assert rows(s, "select /*+ READ_CONSISTENCY(STATIC) */ * from t") == rows(s, "select /*+ read_static */ * from t") == []
    assert rows(s, "select /*+ read_consistency(weak) no_such_hint(3) */ c2 from t where c1 = 1") == [(2,)]
    s.store.freeze()
    s.sql("update t set c2 = 9 where c1 = 1")
    assert rows(s, "select /*+ read_consistency(frozen) */ c2 from t where c1 = 1") == [(2,)]
    assert rows(s, "select c2 from t") == [(4,), (9,)]  # the expired row went when the increments were merged
    s.store.freeze("t")
    assert rows(s, "select /*+ read_static */ c2 from t") == [(4,), (9,)]


def test_lookups_expiry_and_increments_in_one_scan(s):
    s.sql("create table r (a int primary key, b varchar(9))")
    s.sql("create table t (k int primary key, a int, b varchar(9)) join_info = '[a$a]%r:b$b', expire_info = 'k = 2'")
    s.sql("insert into r values (1, 'one'), (2, 'two')")
    s.sql("insert into t (k, a) values (1, 1), (2, 2), (3, 7)")
    with pytest.raises(StatementError):
        s.sql("insert into t (k, b) values (5, 'x')")
    s.store.freeze()
    s.sql("update r set b = 'uno' where a = 1")
    s.sql("update t set a = 2 where k = 3")
    assert rows(s, "select * from t") == [(1, 1, "uno"), (3, 2, "two")]
    assert rows(s, "select /*+ read_static */ * from t") == [(1, 1, "one"), (3, 7, None)]


def test_prepared_and_variables(s):
    s.sql("create table t (k int primary key, v varchar(9))")
    s.sql("set @a = 1, @b = 'what?'")
    s.sql("prepare p from 'insert into t values (?, ?)'")
    s.sql("execute p using @a, @b")
    s.sql("prepare q from 'select v, ''?'' as mark from t where k = ?'")
    assert rows(s, "execute q using @a") == [("what?", "?")]
    assert rows(s, "select @a + 1 as x, '@a' as y") == [(2, "@a")]
    s.sql("deallocate prepare q")
    with pytest.raises(KeyError):
        s.sql("execute q using @a")
    assert any("Project" in r["plan"] for r in s.sql("explain select * from t").collect())
    assert any("Project" in r["plan"] for r in s.sql("explain update t set v = 'x' where k = 1").collect())
    assert rows(s, "select v from t") == [("what?",)]


def test_show(s):
    s.sql("create table one (k int primary key, v int default 3) comment = 'first', expire_info = 'v < 0'")
    s.sql("create table two (k int primary key)")
    assert rows(s, "show tables") == [("one",), ("two",)] and rows(s, "show tables like 'o%'") == [("one",)]
    assert s.sql("show create table one").first()[1] == "CREATE TABLE one (k int, v int default 3, PRIMARY KEY (k)) EXPIRE_INFO='v < 0', COMMENT='first'"
    assert [r["column_name"] for r in s.sql("show columns from one like 'v%'").collect()] == ["v"]
    assert s.sql("show schema").count() == 3
    s.sql("insert into one (k) values (1)")
    s.store.freeze("one")
    s.sql("insert into one (k) values (2)")
    assert [tuple(r)[3:] for r in s.sql("show table status like 'one'").collect()] == [("snappy", 3 + 1, 1)]
    assert s.sql("show server status").count() >= 1
    assert s.sql("show grants").first()[0].startswith("GRANT ALL PRIVILEGES ON * TO '")
    assert s.sql("show processlist").columns == ["id", "user", "state"]
    assert ("autocommit", "1") in rows(s, "show global variables like 'auto%'")
    assert s.sql("show parameters like 'spark.sql.shuffle.partitions'").count() == 1
    with pytest.raises(ValueError):
        s.sql("show nothing")


def test_reading_statements():
    assert st.split("a = 'x,y', b = f(1, 2), c", ",") == ["a = 'x,y'", "b = f(1, 2)", "c"]
    c = st.change("update t set a = case when b > 1 then 2 else 3 end where k = 1 -- note\n when row_count(delete from u where k = 2) = 1;")
    assert c.assignments == {"a": "case when b > 1 then 2 else 3 end"} and c.where == "k = 1" and c.when.startswith("row_count(")
    assert st.hints("select /*+ A, b(C) */ 1") == {"a": None, "b": "c"}
    for bad in ("insert into t values (1", "update t v = 1", "delete from t where k = 1 limit 3 when 1 then"):
        with pytest.raises(ValueError):
            st.pinned(st.change(bad).where + " oops", ["j"])


def test_users_and_grants(s, spark):
    log_in = lambda name, password: Session(spark, store=Store(spark, s.store.root), user=name, password=password)
    s.sql("create table t (k int primary key, v int)")
    s.sql("create table u (k int primary key)")
    s.sql("create user 'ann' identified by 'one', 'bob' identified by 'two'")
    for name, password in (("ann", "two"), ("eve", "one")):
        with pytest.raises(PermissionError):
            log_in(name, password)
    ann = log_in("ann", "one")
    for text in ("insert into t values (1, 1)", "select * from t", "create table x (k int primary key)", "grant select on t to 'ann'", "drop user 'bob'"):
        with pytest.raises(PermissionError):
            ann.sql(text)
    s.sql("grant insert, select on t to 'ann', 'bob'")
    assert n(ann, "insert into t values (1, 1)") == 1 and rows(ann, "select v from t") == [(1,)] and ann.sql("select 1 as x").count() == 1
    with pytest.raises(PermissionError):
        ann.sql("select * from t join u on t.k = u.k")
    assert rows(ann, "show grants") == rows(s, "show grants for 'ann'") == [("GRANT INSERT, SELECT ON t TO 'ann'",)]
    s.sql("revoke insert on t from 'ann'")
    with pytest.raises(PermissionError):
        ann.sql("insert into t values (2, 2)")
    s.sql("grant all privileges on * to 'bob'")
    bob = log_in("bob", "two")
    bob.sql("create table y (k int primary key)")
    assert rows(bob, "show grants")[0] == ("GRANT ALL PRIVILEGES ON * TO 'bob'",)
    with pytest.raises(PermissionError):
        bob.sql("grant select on t to 'ann'")
    s.sql("set password for 'ann' = 'three'")
    s.sql("rename user 'ann' to 'anna'")
    assert log_in("anna", "three").user == "anna"
    s.sql("alter user 'anna' locked")
    with pytest.raises(PermissionError):
        log_in("anna", "three")
    s.sql("drop user 'bob'")
    assert rows(s, "select user_name, is_locked from __all_user") == [("anna", 1)]
    for bad in ("create user 'anna' identified by 'x'", "drop user 'bob'", "grant fly on t to 'anna'", "revoke select on t from 'bob'"):
        with pytest.raises(StatementError):
            s.sql(bad)
    assert "three" not in str(s.store.state())


def test_rows_of_others_do_not_hinder_a_commit(s, spark):
    other = Session(spark, store=Store(spark, s.store.root))
    s.sql("create table t (k int primary key, a int)")
    s.sql("insert into t values (1, 1), (2, 2), (3, 3)")
    s.sql("begin")
    s.sql("update t set a = 10 where k = 1")
    other.sql("update t set a = 20 where k = 2")
    other.sql("insert into t values (4, 4)")
    s.sql("commit")
    assert rows(s, "select * from t") == [(1, 10), (2, 20), (3, 3), (4, 4)]
    for other_does, fails in (("update t set a = 0 where k = 3", True), ("update t set a = 0 where k = 2", False), ("alter table t add b int", True)):
        s.sql("begin")
        assert s.sql("select a from t where k = 3 for update").count() == 1
        s.sql("update t set a = a + 1 where k = 1")
        other.sql(other_does)
        if fails:
            with pytest.raises(ConcurrentChange):
                s.sql("commit")
        else:
            s.sql("commit")
    assert rows(s, "select k, a from t") == [(1, 11), (2, 0), (3, 0), (4, 4)]
