"""The engine's queries over the driver's tables, and for each the SQL that an independent engine runs."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import predicates as P
from quern.functions import scalar as S
from quern.operators import dml, merge
from quern.operators.prejoin import prejoin, timed_prejoin
from quern.operators.relational import aggregate, group, join, limit, set_operation, sort, top
from quern.plans.scan import scan
from quern.plans.session import Session
from quern.plans.statements import StatementError
from quern.sources import catalog as C
from quern.sources.importer import load_files
from quern.sources.store import ConcurrentChange, Store
from quern.streaming import changelog

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable], Callable]:
    """Register a function of (tables by name) -> DataFrame under its own name, with its SQL."""

    def put(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: C.load(spark, sf_dir, name))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def same(name: str, sql: str, spark_sql: str | None = None) -> None:
    """Register SQL that both engines run (or a Spark spelling of its own)."""

    text = spark_sql or sql
    named = [n for n in C.TABLES if re.search(rf"\b{n}\b", text)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        C.views(spark, sf_dir, named)
        return spark.sql(text)

    QUERIES[name], SQL[name] = run, sql


def shared(spark: SparkSession, label: str) -> str:
    """A new folder under spark.checkpoint.dir; only on one machine may that be unset, which then has it in the warehouse."""
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    top = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/quern-tmp"
    path = f"{top.rstrip('/')}/quern-{label}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def money(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 2)


# --- Scans, sources, sinks ---------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def s1_scan(t):
    return t("lineitem").filter("l_quantity > 45 AND l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT x.o_orderkey, x.o_totalprice FROM (SELECT * FROM orders WHERE o_orderstatus = 'F') x WHERE x.o_totalprice > 200000")
def s3_derived_scan(t):
    return t("orders").filter("o_orderstatus = 'F'").alias("x").filter("x.o_totalprice > 200000").select("x.o_orderkey", "x.o_totalprice")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def s6_multi_get(t):
    keys = t("orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return C.multi_get(t("customer").select("c_custkey", "c_name", "c_acctbal"), keys, ["c_custkey"])


@query("SELECT * FROM orders WHERE o_orderkey = 7")
def s6_point_get(t):
    return C.point_get(t("orders"), o_orderkey=7)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey <= 400")
def s7_range_scan(t):
    return C.key_range(t("orders").select("o_orderkey", "o_custkey"), "o_orderkey", 100, 400, high_in=True)


@query("SELECT event_id, ts, user_id FROM events WHERE event_id > 500 AND event_id <= 900")
def s11_increment_scan(t):
    log = t("events").withColumn("_version", F.col("event_id"))
    return merge.version_range(log, 500, 900).select("event_id", "ts", "user_id")


@query("SELECT * FROM (VALUES (1::BIGINT, 'a'), (2::BIGINT, NULL), (3::BIGINT, 'c')) v(k, s)")
def s14_static_rows(t):
    spark = t("region").sparkSession
    return spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k long, s string")


same("s16_values", "SELECT k, s FROM (VALUES (1, 'x'), (2, 'y')) AS v(k, s)")
same("s17_dual", "SELECT 1 AS one, 'a' AS a, 1 + 2 AS three")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC")
def s19_reverse_scan(t):
    return C.key_range(t("orders").select("o_orderkey", "o_totalprice"), "o_orderkey", reverse=True)


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, CASE WHEN n_regionkey = 2 THEN NULL ELSE n_regionkey::BIGINT END AS n_regionkey FROM nation")
def s22_delimited_round_trip(t):
    df = t("nation").withColumn("n_regionkey", F.when(F.col("n_regionkey") != 2, F.col("n_regionkey")))
    path = shared(df.sparkSession, "nation")
    C.write_delimited(df, path)
    declared = C.Table("nation", (("n_nationkey", "int"), ("n_name", "varchar(25)"), ("n_regionkey", "int")), ("n_nationkey",))
    return C.read_delimited(df.sparkSession, path, declared)


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_nationkey = 3")
def s23_delimited_export(t):
    df = t("customer")
    path = shared(df.sparkSession, "export")
    C.write_delimited(df, path, sep="|", columns=["c_custkey", "c_mktsegment"], where=F.col("c_nationkey") == 3)
    declared = C.Table("customer", (("c_custkey", "bigint"), ("c_mktsegment", "varchar(10)")), ("c_custkey",))
    return C.read_delimited(df.sparkSession, path, declared, sep="|")


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey BETWEEN 3 AND 60")
def s24_bulk_build(t):
    df = t("supplier").select("s_suppkey", "s_name", "s_acctbal")
    path = shared(df.sparkSession, "base")
    C.write_base(df, path, ["s_suppkey"], bloom=True)
    return df.sparkSession.read.parquet(path).filter("s_suppkey BETWEEN 3 AND 60")


@query("SELECT * FROM (VALUES ('nation', 'n_nationkey', 1::BIGINT, 1::BIGINT, 'int'), ('nation', 'n_name', 2, 0, 'varchar(25)'), ('nation', 'n_regionkey', 3, 0, 'int'), ('region', 'r_regionkey', 1, 1, 'int'), ('region', 'r_name', 2, 0, 'varchar(25)'), ('region', 'r_more', 3, 0, 'double')) v(table_name, column_name, position, rowkey_id, data_type)")
def s25_system_columns(t):
    s = _database(t, "nation", "region")
    s.sql("alter table region add r_more double")
    return s.sql("select * from __all_all_column")


@query("SELECT * FROM (VALUES ('customer', 4::BIGINT, 'c_custkey', '[c_nationkey$n_nationkey]%nation:c_nation$n_name'), ('nation', 3, 'n_nationkey', NULL)) v(table_name, column_num, rowkey, join_info)")
def s25_system_tables(t):
    return _database(t, "nation", "customer").sql("select table_name, column_num, rowkey, join_info from __first_tablet_entry")


@query("SELECT TRUE AS one, TRUE AS mine")
def s25_sessions(t):
    """The session's own row in the table of sessions, and the servers' table."""
    s = _database(t)
    mine = s.sql("select count(*) = 1 as mine from __all_server_session where user = current_user()")
    return s.sql("select count(*) >= 1 as one from __all_server").join(mine, F.lit(True))


@query("SELECT codec, count(*) AS n, sum(s_suppkey)::BIGINT AS keys FROM supplier, (VALUES ('none'), ('lz4'), ('snappy')) v(codec) GROUP BY codec")
def s21_codecs(t):
    """The same base in each codec; lz4 stands for lzo."""
    df = t("supplier")
    out = []
    for codec in ("none", "lz4", "snappy"):
        path = shared(df.sparkSession, f"base-{codec}")
        C.write_base(df, path, ["s_suppkey"], codec=codec)
        out.append(df.sparkSession.read.parquet(path).groupBy(F.lit(codec).alias("codec")).agg(F.count("*").alias("n"), long(F.sum("s_suppkey")).alias("keys")))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT r_regionkey::BIGINT AS k, 'a' || chr(10) || '|' || chr(92) || r_name AS s, CASE WHEN r_regionkey = 2 THEN NULL ELSE '' END AS e FROM region")
def s23_escaped_round_trip(t):
    """Separators, line ends, backslashes, empty texts and NULL come back as they were."""
    df = t("region").select(long("r_regionkey").alias("k"), F.concat(F.lit("a\n|\\"), "r_name").alias("s"), F.when(F.col("r_regionkey") != 2, "").alias("e"))
    path = shared(df.sparkSession, "escaped")
    C.write_delimited(df, path, sep="|", escaped=True)
    return C.read_delimited(df.sparkSession, path, C.Table("t", (("k", "int"), ("s", "varchar(99)"), ("e", "varchar(9)")), ("k",)), sep="|", escaped=True)


@query("SELECT * FROM (VALUES (1::BIGINT, 'one', 'x'), (2, NULL, 'y'), (5, 'kept', 'z')) v(k, a, b) UNION ALL SELECT 100, '2', '3'")
def s24b_import_job(t):
    """A configured job: title, record delimiter, NULL and unchanged flags, a column that is skipped, lines refused into a file, and deletes."""
    spark = t("region").sparkSession
    s = Session(spark, store=Store(spark, shared(spark, "store")))
    s.sql("create table t (k int primary key, a varchar(9), b varchar(9))")
    s.sql("insert into t values (3, 'old', 'w'), (5, 'kept', 'v')")
    top = shared(spark, "import")
    text = "key|skip|a|b~1|-|one|x~2|-|\\N|y~5|-|-|z~six|-|a|b~7|short"
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.option("lineSep", "~").text(f"{top}/rows")
    spark.createDataFrame([("3",)], "value string").write.text(f"{top}/gone")
    counts = load_files(s.store, f"[t]\ndata = {top}/rows\ncolumns = k, -, a, b\ndelimiter = |\nrecord_delimiter = ~\nnop = -\ntitle = true\nbad = {top}/bad\n")
    load_files(s.store, f"[t]\ndata = {top}/gone\ncolumns = k\ndelete = true\n")
    bad = spark.read.text(f"{top}/bad").count()
    return s.sql("select * from t").unionByName(spark.createDataFrame([(100, str(bad), str(counts["t"][0]))], "k long, a string, b string"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 1000 AND o_orderkey < 5000")
def s24c_range_reader(t):
    """A range of keys of base files on any storage that Spark reaches; sorted files let others be skipped."""
    df = t("orders").select("o_orderkey", "o_totalprice")
    path = shared(df.sparkSession, "far")
    C.write_base(df, path, ["o_orderkey"])
    return C.key_range(df.sparkSession.read.parquet(path), "o_orderkey", 1000, 5000)


@query("SELECT c_custkey::BIGINT AS c_custkey, c_name, upper(n_name) AS nation FROM (SELECT c_custkey, CASE WHEN c_custkey = 7 THEN 'seven' ELSE c_name END AS c_name, CASE WHEN c_custkey = 8 THEN 1 ELSE c_nationkey END AS c_nationkey FROM customer WHERE c_custkey <> 9) LEFT JOIN (SELECT n_nationkey, CASE WHEN n_nationkey = 1 THEN 'renamed' ELSE n_name END AS n_name FROM nation) ON c_nationkey = n_nationkey WHERE c_name <> 'x'")
def s5_composed_scan(t):
    """One scan of base, increments and the columns that a lookup fills, itself from base and increments, with the builder's conditions over it."""
    s = _database(t, "nation", "customer")
    s.store.freeze()
    for text in ("update customer set c_name = 'seven' where c_custkey = 7", "update customer set c_nationkey = 1 where c_custkey = 8", "delete from customer where c_custkey = 9", "update nation set n_name = 'renamed' where n_nationkey = 1"):
        s.sql(text)
    rows = s.store.read(s.store.state(), "customer")
    return scan(rows).columns("c_custkey", "c_name").compute(nation="upper(c_nation)").where("c_name", "!=", "x").run()


# --- Projection, filter, predicates ------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 5) AS net FROM lineitem")
def p1_project(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 5).alias("net"))


@query("SELECT *, s_acctbal < 0 AS in_debt, length(s_name) AS name_length FROM supplier")
def p2_add_project(t):
    return t("supplier").withColumns({"in_debt": F.col("s_acctbal") < 0, "name_length": S.length(F.col("s_name")).cast("long")})


same("p3_filter", "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND (o_orderstatus = 'O' OR o_orderpriority LIKE '1%')")


@query("SELECT n_nationkey AS id, n_name AS name FROM nation")
def p4_rename(t):
    return t("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))


same("p5_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
same("p6_alias_reuse", "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS q2, q2 + 1 AS q3 FROM lineitem")


@query("SELECT n, b FROM (SELECT CASE WHEN c_mktsegment <> 'BUILDING' THEN c_name END AS n, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS b FROM customer) WHERE n IS NOT NULL OR b IS NOT NULL")
def p8_empty_row_filter(t):
    rows = t("customer").select(F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_name")).alias("n"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("b"))
    return rows.dropna("all")


same("p9_case_searched", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'middle' END AS band FROM orders")
same("p9_case_simple", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 3 END AS code FROM orders")
same("p10_scalar_subquery", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
same("p11_in_subquery", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
same("p11_row_in_subquery", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey, l_suppkey) IN (SELECT o_orderkey, o_custkey FROM orders)")
same("p11_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)")
same("p11_not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 100000)")
same("p12_derived_table", "SELECT d.o_custkey, d.n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) d WHERE d.n >= 10")

_NULLED = "(SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 7 END AS v FROM orders)"


def _nulled(t) -> DataFrame:
    return t("orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 7).alias("v"))


@query(f"SELECT k, v IS NULL AS a, v IS NOT NULL AS b, coalesce(v <> 0, FALSE) AS c, coalesce(v > 3, FALSE) AS d FROM {_NULLED}")
def pred_is(t):
    v = F.col("v")
    return _nulled(t).select("k", v.isNull().alias("a"), v.isNotNull().alias("b"), P.is_true(v).alias("c"), P.is_true(v > 3).alias("d"))


same("pred_between", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_discount NOT BETWEEN 0.02 AND 0.05")
same("pred_like", "SELECT p_partkey FROM part WHERE p_name LIKE '%a%' AND p_type NOT LIKE '_R%'")


@query("SELECT p_partkey FROM part WHERE contains(p_type, 'O')")
def pred_legacy_like(t):
    return t("part").filter(P.legacy_like(F.col("p_type"), "O")).select("p_partkey")


_IN = "CASE WHEN v IS NOT DISTINCT FROM 1 OR v IS NOT DISTINCT FROM 2 OR v IS NULL THEN TRUE END"


@query(f"SELECT k, {_IN} AS with_null, NOT ({_IN}) AS not_with_null, CASE WHEN v IN (1, 2) THEN TRUE WHEN v IS NULL THEN NULL ELSE FALSE END AS plain FROM {_NULLED}")
def pred_in_null(t):
    v, null = F.col("v"), F.lit(None).cast("long")
    return _nulled(t).select("k", P.in_list(v, 1, 2, null).alias("with_null"), P.not_in_list(v, 1, 2, null).alias("not_with_null"), P.in_list(v, 1, 2).alias("plain"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_linenumber = 1 AND l_returnflag = 'R') OR (l_linenumber = 2 AND l_returnflag = 'A')")
def pred_row_in(t):
    return t("lineitem").filter(P.row_in((F.col("l_linenumber"), F.col("l_returnflag")), (1, "R"), (2, "A"))).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber % 2 <> 0 AND NOT (l_orderkey % 5 <> 0)")
def pred_truth(t):
    return t("lineitem").filter(S.truth(F.col("l_linenumber") % 2) & ~S.truth(F.col("l_orderkey") % 5)).select("l_orderkey", "l_linenumber")


# --- Joins -------------------------------------------------------------------------------------------------------


def _whole(t) -> tuple[DataFrame, DataFrame, Column]:
    """All customers and all orders; orders in progress and customers in building match nothing."""
    c, o = t("customer").select("c_custkey", "c_name", "c_mktsegment"), t("orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return c, o, (F.col("c_custkey") == F.col("o_custkey")) & (F.col("o_orderstatus") != "P") & (F.col("c_mktsegment") != "BUILDING")


_C_ALL, _O_ALL = "(SELECT c_custkey, c_name, c_mktsegment FROM customer) c", "(SELECT o_orderkey, o_custkey, o_orderstatus FROM orders) o"
_ON_ALL = "c_custkey = o_custkey AND o_orderstatus <> 'P' AND c_mktsegment <> 'BUILDING'"
for _how, _sql in {
    **{h: f"SELECT * FROM {_C_ALL} {w} {_O_ALL} ON {_ON_ALL}" for h, w in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("full", "FULL JOIN"))},
    "left_semi": f"SELECT * FROM {_C_ALL} WHERE EXISTS (SELECT 1 FROM {_O_ALL} WHERE {_ON_ALL})",
    "right_semi": f"SELECT * FROM {_O_ALL} WHERE EXISTS (SELECT 1 FROM {_C_ALL} WHERE {_ON_ALL})",
    "left_anti": f"SELECT * FROM {_C_ALL} WHERE NOT EXISTS (SELECT 1 FROM {_O_ALL} WHERE {_ON_ALL})",
    "right_anti": f"SELECT * FROM {_O_ALL} WHERE NOT EXISTS (SELECT 1 FROM {_C_ALL} WHERE {_ON_ALL})",
}.items():

    def _f(t, how=_how):
        return join(*_whole(t), how)

    _f.__name__ = f"{'j4' if _how.endswith(('semi', 'anti')) else 'j3'}_{_how}_join"
    query(_sql)(_f)

same("j5_comma_join", "SELECT o_orderkey, c_name FROM orders, customer WHERE o_custkey = c_custkey AND c_mktsegment = 'BUILDING'")
same("j6_theta_join", "SELECT a.n_nationkey AS x, b.r_regionkey AS y FROM nation a JOIN region b ON a.n_regionkey > b.r_regionkey")
same("j6_theta_left_join", "SELECT a.r_regionkey AS x, b.n_nationkey AS y FROM region a LEFT JOIN nation b ON a.r_regionkey > b.n_regionkey AND b.n_nationkey < 10")
same("j7_expression_join", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_nationkey = b.n_nationkey + 1")
same("j8_many_tables", "SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey, region WHERE n_regionkey = r_regionkey AND r_name = 'ASIA'")
same("j9_self_join", "SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")


@query(f"SELECT a.k, b.k AS other FROM {_NULLED} a JOIN {_NULLED} b ON a.v = b.v AND a.k = b.k")
def j10_null_keys(t):
    a, b = _nulled(t), _nulled(t).select(F.col("k").alias("other"), F.col("v").alias("w"))
    return join(a, b, (F.col("v") == F.col("w")) & (F.col("k") == F.col("other"))).select("k", "other")


_LOOKUP = "[c_nationkey$n_nationkey]%nation:c_nation$n_name,c_region$n_regionkey"


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, n_name AS c_nation, n_regionkey AS c_region FROM (SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 = 0 THEN 99 ELSE c_nationkey END AS c_nationkey, c_acctbal, c_mktsegment FROM customer) LEFT JOIN nation ON c_nationkey = n_nationkey")
def j11_prejoin(t):
    left = t("customer").withColumn("c_nationkey", F.when(F.col("c_custkey") % 10 == 0, 99).otherwise(F.col("c_nationkey")))
    return prejoin(left, t("nation"), C.parse_join_info(_LOOKUP), ["n_nationkey"])


@query(
    "SELECT a.k, b.name, CASE WHEN b.k IS NOT NULL AND a.made IS NOT NULL THEN least(a.made, b.made) ELSE a.made END AS made,"
    " CASE WHEN b.k IS NOT NULL AND a.changed IS NOT NULL THEN greatest(a.changed, b.changed) ELSE a.changed END AS changed"
    " FROM (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate END AS made, o_orderdate AS changed FROM orders) a"
    " LEFT JOIN (SELECT l_orderkey AS k, l_returnflag AS name, l_shipdate AS made, l_shipdate AS changed FROM lineitem WHERE l_linenumber = 1) b ON a.k = b.k"
)
def j14_timed_prejoin(t):
    a = t("orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate")).alias("made"), F.col("o_orderdate").alias("changed"))
    b = t("lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("name"), F.col("l_shipdate").alias("made"), F.col("l_shipdate").alias("changed"))
    return timed_prejoin(a, b, ["k"], created="made", modified="changed", columns=["name"])


# --- Aggregation -------------------------------------------------------------------------------------------------


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, count(l_quantity) AS n_q, round(sum(l_quantity), 2) AS s, min(l_quantity) AS lo, max(l_quantity) AS hi, round(avg(l_discount), 6) AS a FROM lineitem GROUP BY ALL")
def a1_group(t):
    aggs = {"n": aggregate("count"), "n_q": aggregate("count", "l_quantity"), "s": money(aggregate("sum", "l_quantity")), "lo": aggregate("min", "l_quantity"), "hi": aggregate("max", "l_quantity"), "a": F.round(aggregate("avg", "l_discount"), 6)}
    return group(t("lineitem"), ["l_returnflag", "l_linestatus"], aggs)


@query(f"SELECT v, count(*) AS n, count(v) AS n_v, sum(v)::BIGINT AS s, min(k) AS lo FROM {_NULLED} GROUP BY v")
def a1_null_group(t):
    return group(_nulled(t), ["v"], {"n": aggregate("count"), "n_v": aggregate("count", "v"), "s": aggregate("sum", "v"), "lo": aggregate("min", "k")})


@query("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS s, max(o_orderkey) AS hi FROM orders")
def a3_scalar(t):
    return group(t("orders"), [], {"n": aggregate("count"), "s": money(aggregate("sum", "o_totalprice")), "hi": aggregate("max", "o_orderkey")})


@query("SELECT count(*) AS n, count(l_tax) AS c, sum(l_tax) AS s, min(l_tax) AS lo, max(l_tax) AS hi, avg(l_tax) AS a FROM lineitem WHERE l_quantity < 0")
def a3_scalar_empty(t):
    empty = t("lineitem").filter("l_quantity < 0")
    return group(empty, [], {"n": aggregate("count"), "c": aggregate("count", "l_tax"), "s": aggregate("sum", "l_tax"), "lo": aggregate("min", "l_tax"), "hi": aggregate("max", "l_tax"), "a": aggregate("avg", "l_tax")})


@query("SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts, round(sum(DISTINCT l_quantity), 2) AS q, round(avg(DISTINCT l_quantity), 6) AS a, max(DISTINCT l_tax) AS hi FROM lineitem GROUP BY l_returnflag")
def a5_distinct(t):
    d = lambda f, c: aggregate(f, c, distinct=True)
    return group(t("lineitem"), ["l_returnflag"], {"suppliers": d("count", "l_suppkey"), "parts": d("count", "l_partkey"), "q": money(d("sum", "l_quantity")), "a": F.round(d("avg", "l_quantity"), 6), "hi": d("max", "l_tax")})


same("a6_distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
same("a8_group_expression", "SELECT o_orderkey % 10 AS g, count(*) AS n FROM orders GROUP BY o_orderkey % 10")
same("a9_group_alias", "SELECT CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'credit' END AS side, count(*) AS n FROM customer GROUP BY side")


@query("SELECT o_custkey, count(*) AS n, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus, arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey")
def a10_first_of_group(t):
    return group(t("orders"), ["o_custkey"], {"n": aggregate("count")}, first=["o_orderstatus", "o_totalprice"], by=["o_orderkey"])


same("a11_having_scalar", "SELECT count(*) AS n FROM orders HAVING count(*) > 10")
same("a12_order_by_aggregate", "SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY max(o_orderkey) DESC")


@query("SELECT o_custkey, count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders GROUP BY o_custkey HAVING count(*) >= 10")
def a13_native_group(t):
    return scan(t("orders")).group_by("o_custkey", n=("count", "o_orderkey"), lo=("min", "o_orderkey"), hi=("max", "o_orderkey")).having("n", ">=", 10).run()


@query("SELECT l_partkey, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY l_partkey ORDER BY q DESC, l_partkey LIMIT 10")
def a15_top_groups(t):
    return scan(t("lineitem")).group_by("l_partkey", s=("sum", "l_quantity")).ratio(q="round(s, 2)").topk_precision(100, 0.9).order_by("-q", "l_partkey").limit(10).run().drop("s")


# --- Sort, limit, top-k ------------------------------------------------------------------------------------------


@query("SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier ORDER BY s_nationkey, s_acctbal DESC, s_suppkey")
def o1_sort(t):
    return sort(t("supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), F.asc("s_nationkey"), F.desc("s_acctbal"), F.asc("s_suppkey"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25")
def o4_limit_offset(t):
    return limit(sort(t("orders").select("o_orderkey", "o_totalprice"), "o_orderkey"), 10, 25)


@query("SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20")
def o4_offset_only(t):
    return limit(sort(t("nation").select("n_nationkey"), "n_nationkey"), None, 20)


@query("SELECT o_custkey, o_orderkey FROM orders ORDER BY 1, 2 DESC")
def o5_ordinal(t):
    return sort(t("orders").select("o_custkey", "o_orderkey"), 1, -2)


same("o6_order_hidden", "SELECT o_orderkey FROM orders ORDER BY o_totalprice * 2 DESC, o_orderkey")


@query(f"SELECT k, v FROM {_NULLED} ORDER BY v ASC NULLS FIRST, k")
def o7_nulls_first(t):
    return _nulled(t).orderBy(F.asc("v"), F.asc("k"))


@query(f"SELECT k, v FROM {_NULLED} ORDER BY v DESC NULLS LAST, k")
def o7_nulls_last(t):
    return _nulled(t).orderBy(F.desc("v"), F.asc("k"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def o8_top_k(t):
    return top(t("orders").select("o_orderkey", "o_totalprice"), 25, F.desc("o_totalprice"), F.asc("o_orderkey"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice, o_orderkey LIMIT 10 OFFSET 5")
def o10_return(t):
    return top(t("orders").filter("o_orderstatus = 'O'").select("o_orderkey", "o_totalprice"), 10, "o_totalprice", "o_orderkey", offset=5).select("o_orderkey")


# --- Set operations ----------------------------------------------------------------------------------------------

_L, _R = "SELECT c_custkey AS k FROM customer", "SELECT o_custkey FROM orders"
for _kind in ("union", "intersect", "except"):
    for _every in (False, True):

        def _f(t, kind=_kind, every=_every):
            return set_operation(kind, t("customer").select(F.col("c_custkey").alias("k")), t("orders").select("o_custkey"), every=every)

        _f.__name__ = f"u_{_kind}{'_all' * _every}"
        query(f"{_L} {_kind.upper()}{' ALL' * _every} {_R}")(_f)


@query("SELECT 'union' AS kind, TRUE AS refused UNION ALL SELECT 'intersect', TRUE UNION ALL SELECT 'except', TRUE")
def u8_arity(t):
    """Branches of unequal width are refused."""

    def refused(kind: str) -> bool:
        try:
            set_operation(kind, t("nation"), t("region").select("r_regionkey"))
        except ValueError:
            return True
        return False

    return t("nation").sparkSession.createDataFrame([(k, refused(k)) for k in ("union", "intersect", "except")], "kind string, refused boolean")


same("u9_order_by", "SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey FROM region ORDER BY k DESC")
same("u10_branches", "(SELECT o_orderkey AS k FROM orders ORDER BY o_orderkey LIMIT 3) UNION ALL (SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 3)")


@query(f"SELECT v FROM {_NULLED} INTERSECT SELECT CASE WHEN n_nationkey < 3 THEN n_nationkey::BIGINT END FROM nation")
def u11_null_equal(t):
    right = t("nation").select(F.when(F.col("n_nationkey") < 3, long("n_nationkey")))
    return set_operation("intersect", _nulled(t).select("v"), right)


# --- Scalar functions --------------------------------------------------------------------------------------------


@query(f"SELECT k, k + v AS a, k - v AS b, k * v AS c, -v AS d FROM {_NULLED}")
def f1_arithmetic(t):
    k, v = F.col("k"), F.col("v")
    return _nulled(t).select("k", S.add(k, v).alias("a"), S.subtract(k, v).alias("b"), S.multiply(k, v).alias("c"), S.negate(v).alias("d"))


@query(f"SELECT k, round(k / nullif(v, 0)::DOUBLE, 9) AS q, k % nullif(v, 0) AS m FROM {_NULLED}")
def f2_divide(t):
    k, v = F.col("k"), F.col("v")
    return _nulled(t).select("k", F.round(S.divide(k, v), 9).alias("q"), S.modulo(k, v).alias("m"))


@query(f"SELECT k, power(v::DOUBLE, 2) AS p FROM {_NULLED}")
def f4_power(t):
    return _nulled(t).select("k", S.power(F.col("v"), 2).alias("p"))


@query("SELECT c_custkey, c_name || '/' || c_nationkey AS s FROM customer")
def f6_concat(t):
    return t("customer").select("c_custkey", S.concat(F.col("c_name"), "/", F.col("c_nationkey")).alias("s"))


@query("SELECT p_partkey, length(p_name) AS n, CAST(NULL AS BIGINT) AS none FROM part")
def f10_length(t):
    return t("part").select("p_partkey", long(S.length(F.col("p_name"))).alias("n"), long(S.length(F.col("p_size"))).alias("none"))


@query("SELECT p_partkey, substr(p_name, 1, 3) AS a, substr(p_name, 1, 4) AS b, CASE WHEN length(p_name) < 6 THEN '' ELSE right(p_name, 6)[1:2] END AS c, '' AS d, '' AS e, substr(p_name, 4) AS f FROM part")
def f11_substr(t):
    n = F.col("p_name")
    return t("part").select("p_partkey", S.substr(n, 0, 3).alias("a"), S.substr(n, 1, 4).alias("b"), S.substr(n, -6, 2).alias("c"), S.substr(n, -1000, 5).alias("d"), S.substr(n, 2, -1).alias("e"), S.substr(n, 4).alias("f"))


@query("SELECT c_custkey, coalesce(try_cast(regexp_extract(c_custkey || '.9x', '^\\d+') AS BIGINT), 0) AS lead, CAST(c_acctbal AS VARCHAR) IS NOT NULL AS s FROM customer")
def f12_cast(t):
    return t("customer").select("c_custkey", S.cast_int(F.concat(F.col("c_custkey").cast("string"), F.lit(".9x"))).alias("lead"), F.col("c_acctbal").cast("string").isNotNull().alias("s"))


@query("SELECT o_orderkey, epoch_us(o_orderdate) AS us FROM orders")
def f12_cast_time(t):
    return t("orders").select("o_orderkey", S.cast_int(F.col("o_orderdate").cast("timestamp")).alias("us"))


@query("SELECT n_nationkey, regexp_replace('xyxy' || n_name || 'xyx', '^(xy)+', '') AS lead, regexp_replace('ab' || n_name || 'yxyx', '(yx)+$', '') AS trail, trim('  ' || n_name || ' ') AS spaces FROM nation")
def f14_trim(t):
    n = F.col("n_name")
    return t("nation").select("n_nationkey", S.trim(S.concat("xyxy", n, "xyx"), "xy", "leading").alias("lead"), S.trim(S.concat("ab", n, "yxyx"), "yx", "trailing").alias("trail"), S.trim(S.concat("  ", n, " ")).alias("spaces"))


same("f15_case", "SELECT c_custkey, lower(c_name) AS lo, upper(c_mktsegment) AS up FROM customer")


@query(f"SELECT k, coalesce(v, -1) AS c FROM {_NULLED}")
def f16_coalesce(t):
    return _nulled(t).select("k", F.coalesce("v", F.lit(-1)).alias("c"))


@query("SELECT c_custkey, lower(to_hex(c_custkey)) AS i, lower(hex(c_name)) AS s, CAST(NULL AS VARCHAR) AS f, c_name AS back, CAST(NULL AS VARCHAR) AS bad FROM customer")
def f17_hex(t):
    n = F.col("c_name")
    return t("customer").select("c_custkey", S.hex_of(F.col("c_custkey")).alias("i"), S.hex_of(n).alias("s"), S.hex_of(F.col("c_acctbal")).alias("f"), S.unhex(F.hex(n)).alias("back"), S.unhex(S.concat(F.lit("0g"), n)).alias("bad"))


@query("SELECT event_id, (event_id % 256) + 256 * (user_id % 256) + 65536 * 7 + 16777216::BIGINT * 200 AS n, (event_id % 256) || '.' || (user_id % 256) || '.7.200' AS ip, CAST(NULL AS BIGINT) AS bad FROM events")
def f19_ip(t):
    ip = S.concat(F.col("event_id") % 256, ".", F.col("user_id") % 256, ".7.200")
    return t("events").select("event_id", S.ip2int(ip).alias("n"), S.int2ip(S.ip2int(ip) + (1 << 32)).alias("ip"), S.ip2int(S.concat(ip, ".1")).alias("bad"))


@query(f"SELECT k, CASE WHEN v IS NULL THEN NULL ELSE greatest(k, v, 5) END AS g, CASE WHEN v IS NULL THEN NULL ELSE least(k, v, 5) END AS l FROM {_NULLED}")
def f21_greatest(t):
    k, v = F.col("k"), F.col("v")
    return _nulled(t).select("k", S.greatest(k, v, 5).alias("g"), S.least(k, v, 5).alias("l"))


#: The time is later than every order's, and one for the whole statement.
same("f22_now", "SELECT count(*) AS n, count(DISTINCT now()) AS times, min(now() > o_orderdate) AS later FROM orders")


@query("SELECT n_nationkey, TRUE AS named FROM nation")
def f13_current_user(t):
    """The session's user, as the process's environment names it."""
    return t("nation").select("n_nationkey", (F.current_user() == F.lit(t("nation").sparkSession.sparkContext.sparkUser())).alias("named"))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity * l_discount - 1, 6) AS e, l_tax IS NOT NULL AND (l_tax > 0.02 OR NOT l_discount <= 0.05) AS f FROM lineitem WHERE contains(l_returnflag, 'A') AND NOT l_quantity < 20")
def f24_infix(t):
    s = scan(t("lineitem")).columns("l_orderkey", "l_linenumber").infix(e="`l_quantity` * `l_discount` - 1", f="`l_tax` is not null and (`l_tax` > 0.02 or not `l_discount` <= 0.05)")
    return s.where_infix("`l_returnflag` like 'A' and not `l_quantity` < 20").run().withColumn("e", F.round("e", 6))


# --- Data changes ------------------------------------------------------------------------------------------------

_NATION = C.Table("nation", (("n_nationkey", "int"), ("n_name", "varchar(25)"), ("n_regionkey", "int")), ("n_nationkey",))
_N = "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation"


def _nation(t) -> DataFrame:
    return t("nation").select(long("n_nationkey").alias("n_nationkey"), "n_name", long("n_regionkey").alias("n_regionkey"))


@query(f"{_N} UNION ALL SELECT n_nationkey + 100, lower(n_name), NULL FROM ({_N}) WHERE n_nationkey < 5")
def d1_insert_select(t):
    new = _nation(t).filter("n_nationkey < 5").select(F.col("n_nationkey") + 100, F.lower("n_name"))
    return dml.insert(_nation(t), new, _NATION, ["n_nationkey", "n_name"]).rows


@query(f"{_N} UNION ALL SELECT 60, 'sixty', NULL")
def d2_insert_if_absent(t):
    """A batch with a key that is there adds nothing; one without any is appended."""
    spark = t("nation").sparkSession
    batch = lambda *rows: spark.createDataFrame([*rows], "n_nationkey long, n_name string")
    kept = dml.insert_new(_nation(t), batch((3, "three"), (61, "lost")), _NATION).rows
    return dml.insert_new(kept, batch((60, "sixty")), _NATION).rows


@query(f"SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN 'new' ELSE n_name END AS n_name, CASE WHEN n_nationkey >= 5 THEN n_regionkey END AS n_regionkey FROM ({_N}) UNION ALL SELECT 50, 'new', NULL")
def d3_replace(t):
    new = _nation(t).filter("n_nationkey < 5").select("n_nationkey").union(t("nation").sparkSession.createDataFrame([(50,)], "n long")).withColumn("n_name", F.lit("new"))
    again = new.withColumns({"n_name": F.lit("old"), "place": F.lit(0)}).unionByName(new.withColumn("place", F.lit(1)))
    return dml.replace(_nation(t), again.repartition(3), _NATION, order="place").rows


@query(f"SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN upper(n_name) || '!' ELSE n_name END AS n_name, n_regionkey FROM ({_N})")
def d4_update(t):
    return dml.update(_nation(t), {"n_name": F.concat(F.upper("n_name"), F.lit("!"))}, "n_regionkey = 1", _NATION).rows


@query(f"{_N} WHERE NOT n_regionkey = 1")
def d5_delete(t):
    return dml.delete(_nation(t), "n_regionkey = 1").rows


@query(f"SELECT n_nationkey, CASE WHEN n_nationkey = 1 THEN 'one' ELSE n_name END AS n_name, n_regionkey FROM ({_N})")
def d9_when(t):
    rows = _nation(t)
    done = dml.when(dml.update(rows, {"n_name": F.lit("one")}, "n_nationkey = 1", _NATION), lambda n: n == 1, rows)
    return dml.when(dml.delete(done.rows, "n_nationkey > 1"), lambda n: n == 1, done.rows).rows


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 9")
def d10_select_for_update(t):
    t("orders").createOrReplaceTempView("orders")
    return Session(t("orders").sparkSession).sql("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 9 FOR UPDATE")


@query(f"SELECT n_nationkey, n_name, CAST(NULL AS DOUBLE) AS n_area FROM ({_N})")
def d12_alter_table(t):
    """A column is dropped and another one added; rows written before have NULL there."""
    df = _nation(t)
    path = shared(df.sparkSession, "nation")
    df.write.parquet(path)
    c = C.Catalog(df.sparkSession)
    c.create(_NATION, path)
    c.alter(c.tables["nation"].drop("n_regionkey").add("n_area", "double"))
    return c.read("nation")


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderdate < TIMESTAMP '1995-01-01')")
def d13_expire(t):
    return merge.expire(t("orders"), "o_orderdate < timestamp '1995-01-01'").select("o_orderkey")


def _database(t, *names: str) -> Session:
    """A session over a store of its own, with the tables declared by text and filled from the driver's."""
    declared = {
        "nation": "n_nationkey int primary key, n_name varchar(25), n_regionkey int",
        "region": "r_regionkey int primary key, r_name varchar(25)",
        "customer": "c_custkey int primary key, c_name varchar(25), c_nationkey int, c_nation varchar(25)",
    }
    spark = t("region").sparkSession
    s = Session(spark, store=Store(spark, shared(spark, "store")))
    for name in names:
        join_info = " join_info = '[c_nationkey$n_nationkey]%nation:c_nation$n_name'" if name == "customer" else ""
        s.sql(f"create table {name} ({declared[name]}){join_info}")
        columns = [c.split()[0] for c in declared[name].split(", ") if c.split()[0] != "c_nation"]
        t(name).createOrReplaceTempView(f"given_{name}")
        s.sql(f"insert into {name} ({', '.join(columns)}) select {', '.join(columns)} from given_{name}")
    return s


@query(f"{_N} UNION ALL SELECT n_nationkey + 100, lower(n_name), NULL FROM ({_N}) WHERE n_regionkey = 1 UNION ALL SELECT 1000, 'it''s', 2")
def d1_sql_insert(t):
    s = _database(t, "nation")
    s.sql("insert into nation (n_nationkey, n_name) select n_nationkey + 100, lower(n_name) from nation where n_regionkey = 1")
    s.sql("insert into nation values (1000, 'it''s', 2)")
    return s.sql("select * from nation")


@query(f"SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'last' ELSE n_name END AS n_name, CASE WHEN n_nationkey <> 3 THEN n_regionkey END AS n_regionkey FROM ({_N}) UNION ALL SELECT 50, 'new', 1")
def d3_sql_replace(t):
    s = _database(t, "nation")
    s.sql("replace into nation (n_nationkey, n_name) values (3, 'first'), (3, 'last')")
    s.sql("replace into nation values (50, 'new', 1)")
    return s.sql("select * from nation")


@query(f"SELECT n_nationkey, CASE WHEN n_nationkey IN (1, 2, 3) AND n_regionkey = 1 THEN upper(n_name) || '!' ELSE n_name END AS n_name, CASE WHEN n_nationkey = 7 THEN NULL ELSE n_regionkey END AS n_regionkey FROM ({_N})")
def d4_sql_update(t):
    s = _database(t, "nation")
    s.sql("update nation set n_name = concat(upper(n_name), '!') where n_nationkey in (1, 2, 3) and n_regionkey = 1")
    s.sql("update nation set n_regionkey = null where n_nationkey = 7")
    return s.sql("select * from nation")


@query(f"SELECT * FROM ({_N}) WHERE n_nationkey NOT IN (4, 9)")
def d5_sql_delete(t):
    s = _database(t, "nation")
    s.sql("delete from nation where n_nationkey in (4, 9, 999)")
    return s.sql("select * from nation")


@query("SELECT TRUE AS refused FROM range(6)")
def d5_key_rules(t):
    """What does not give the whole key is refused, NULL tests and other comparisons included."""
    s = _database(t, "region")

    def refused(text: str) -> bool:
        try:
            s.sql(text)
        except StatementError as e:
            return e.code == 5047
        return False

    each = ("r_regionkey != NULL", "r_regionkey is NULL", "r_regionkey > 1")
    return t("region").sparkSession.createDataFrame([(refused(f"{change} where {w}"),) for w in each for change in ("delete from region", "update region set r_name = 'x'")], "refused boolean")


@query(f"SELECT n_nationkey, CASE n_nationkey WHEN 1 THEN 'one' ELSE n_name END AS n_name, CASE n_nationkey WHEN 2 THEN 4 ELSE n_regionkey END AS n_regionkey FROM ({_N})")
def d9_sql_when(t):
    s = _database(t, "nation")
    s.sql("update nation set n_name = 'one' where n_nationkey = 1 when row_count(update nation set n_regionkey = 4 where n_nationkey = 2) = 1")
    s.sql("delete from nation where n_nationkey = 3 when row_count(delete from nation where n_nationkey = 999) > 0")
    return s.sql("select * from nation")


@query(f"SELECT n_nationkey, CASE n_nationkey WHEN 1 THEN 'kept' ELSE n_name END AS n_name, n_regionkey FROM ({_N})")
def d11_transaction(t):
    s = _database(t, "nation")
    for text in ("begin", "update nation set n_name = 'lost' where n_nationkey = 2", "rollback", "begin", "update nation set n_name = 'kept' where n_nationkey = 1", "commit"):
        s.sql(text)
    return s.sql("select * from nation")


@query("SELECT * FROM (VALUES ('ann', 'nation', 'INSERT'), ('ann', 'nation', 'SELECT'), ('bob', 'region', 'SELECT')) v(user_name, table_name, privilege)")
def d18_grants(t):
    s = _database(t, "nation", "region")
    for text in ("create user 'ann' identified by 'a', 'bob' identified by 'b'", "grant insert, select, delete on nation to 'ann'", "revoke delete on nation from 'ann'", "grant select on region to 'bob'"):
        s.sql(text)
    return s.sql("select * from __all_table_privilege")


@query(f"SELECT n_nationkey, CASE n_nationkey WHEN 1 THEN 'first' WHEN 2 THEN 'second' ELSE n_name END AS n_name, n_regionkey FROM ({_N})")
def d6_row_locks(t):
    """Two transactions at once: other rows don't hinder a commit; rows that were read for update or written do, when another commit changed them."""
    s = _database(t, "nation")
    other = Session(s.spark, store=s.store)
    s.sql("begin")
    s.sql("update nation set n_name = 'first' where n_nationkey = 1")
    other.sql("update nation set n_name = 'second' where n_nationkey = 2")
    s.sql("commit")
    s.sql("begin")
    s.sql("select * from nation where n_nationkey = 3 for update")
    s.sql("update nation set n_name = 'lost' where n_nationkey = 4")
    other.sql("update nation set n_regionkey = n_regionkey where n_nationkey = 3")
    try:
        s.sql("commit")
    except ConcurrentChange:
        pass
    return s.sql("select * from nation")


@query(f"SELECT n_nationkey, n_name AS label, CASE WHEN n_nationkey = 77 THEN 1.5::DOUBLE END AS n_area, CAST(NULL AS BIGINT) AS n_regionkey FROM (SELECT * FROM ({_N}) UNION ALL SELECT 77, 'added', NULL)")
def d12_sql_alter(t):
    s = _database(t, "nation")
    s.sql("alter table nation drop column n_regionkey, add n_area double")
    s.sql("alter table nation add n_regionkey int")  # not the column that was dropped
    s.sql("alter table nation rename column n_name to label")
    s.sql("insert into nation (n_nationkey, label, n_area) values (77, 'added', 1.5)")
    return s.sql("select * from nation")


@query("SELECT 2 AS version, n_nationkey, n_name FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 1, n_nationkey, n_name FROM nation")
def d7_snapshots(t):
    """Two versions written one after the other; the current one and the first are read."""
    spark = t("nation").sparkSession
    root = shared(spark, "snapshots")
    dml.write_snapshot(_nation(t), root, 1)
    dml.write_snapshot(dml.delete(_nation(t), "n_regionkey = 1").rows, root, 2)
    now, first = dml.read_snapshot(spark, root), dml.read_snapshot(spark, root, 1)
    return now.select(F.lit(2).alias("version"), "n_nationkey", "n_name").unionByName(first.select(F.lit(1).alias("version"), "n_nationkey", "n_name"))


@query("SELECT TRUE AS filtered, TRUE AS read_few")
def d16_explain(t):
    """The plan of a query names its pushed filter and reads the columns that are asked for."""
    t("orders").createOrReplaceTempView("orders")
    spark = t("orders").sparkSession
    plan = "\n".join(r["plan"] for r in Session(spark).sql("explain select o_custkey from orders where o_orderkey = 7").collect())
    return spark.createDataFrame([("EqualTo(o_orderkey,7)" in plan, "o_totalprice" not in plan)], "filtered boolean, read_few boolean")


@query("SELECT count(*) AS n FROM nation WHERE n_regionkey = 2")
def f23_row_count(t):
    return dml.delete(_nation(t), "n_regionkey = 2").touched.agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey = 7")
def d14_prepared(t):
    spark = t("orders").sparkSession
    t("orders").createOrReplaceTempView("orders")
    s = Session(spark)
    s.prepare("q", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey = ?")
    s.set("@k", 7)
    return s.execute("q", ["@k"])


@query("SELECT o_orderkey FROM orders WHERE o_orderkey < 4")
def d15_variable(t):
    t("orders").createOrReplaceTempView("orders")
    s = Session(t("orders").sparkSession)
    s.set("@top", 4)
    return s.sql("SELECT o_orderkey FROM orders WHERE o_orderkey < @top")


@query("SELECT * FROM (VALUES ('nation'), ('region')) v(table_name)")
def d17_show_tables(t):
    return _database(t, "nation", "region").sql("show tables like '%ion'")


@query("SELECT * FROM (VALUES ('nation', 3::BIGINT, 'n_nationkey', 'snappy', 3::BIGINT, 1::BIGINT), ('region', 2, 'r_regionkey', 'snappy', 0, 1)) v(table_name, column_num, rowkey, codec, base_version, increments)")
def d17_table_status(t):
    s = _database(t, "nation")
    s.store.freeze()
    s.sql("update nation set n_name = 'x' where n_nationkey = 1")
    s.sql("create table region (r_regionkey int primary key, r_name varchar(25))")
    s.sql("insert into region values (1, 'x')")
    return s.sql("show table status")


@query("SELECT * FROM (VALUES ('create table', 1::BIGINT), ('grants', 1), ('warnings', 1), ('schema', 3), ('parameters', 1), ('variables', 1)) v(what, n)")
def d17_show_kinds(t):
    s = _database(t, "nation")
    s.sql("drop table if exists nobody")
    s.sql("set @mine = 3")
    asked = {"create table": "show create table nation", "grants": "show grants", "warnings": "show warnings", "schema": "show schema", "parameters": "show parameters like 'spark.app.name'", "variables": "show variables like 'mine'"}
    return t("nation").sparkSession.createDataFrame([(k, s.sql(v).count()) for k, v in asked.items()], "what string, n long")


# --- Merge on read, change stream --------------------------------------------------------------------------------


def _base(t) -> DataFrame:
    return t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


def _changes(t) -> DataFrame:
    """Deletes, partial updates, a NULL set, a delete and re-insert, and new keys, in versions 1 to 3."""
    o = _base(t)
    k = F.col("o_orderkey")

    def change(when: Column, version: int, seq: int, op: str, sets: list[str], key: Column = k, **values) -> Column:
        cells = [(values[c] if c in values else F.lit(None)).cast(o.schema[c].dataType).alias(c) for c in o.columns[1:]]
        meta = [F.lit(version).cast("long").alias("_version"), F.lit(seq).cast("long").alias("_seq"), F.lit(op).alias("_op"), F.array(*[F.lit(s) for s in sets]).cast("array<string>").alias("_set")]
        return F.when(when, F.struct(key.alias("o_orderkey"), *cells, *meta))

    every = [
        change(k % 10 == 1, 1, 1, "delete", []),
        change(k % 10 == 2, 1, 2, "upsert", ["o_totalprice"], o_totalprice=F.col("o_totalprice") * 2),
        change(k % 10 == 2, 2, 1, "upsert", ["o_orderstatus"], o_orderstatus=F.lit("X")),
        change(k % 10 == 3, 2, 2, "upsert", ["o_orderstatus"]),
        change(k % 10 == 4, 2, 3, "delete", []),
        change(k % 10 == 4, 2, 4, "upsert", ["o_custkey"], o_custkey=F.lit(1)),
        change(k % 50 == 0, 3, 1, "upsert", ["o_custkey", "o_orderstatus"], key=k + 10_000_000, o_custkey=F.lit(5), o_orderstatus=F.lit("N")),
    ]
    return o.select(F.explode(F.array_compact(F.array(*every))).alias("c")).select("c.*")


def _fused_sql(upto: int) -> str:
    m = "o_orderkey % 10"
    status = f"CASE WHEN {m} = 2 AND {upto} >= 2 THEN 'X' WHEN {m} IN (3, 4) AND {upto} >= 2 THEN NULL ELSE o_orderstatus END"
    price = f"CASE WHEN {m} = 2 THEN o_totalprice * 2 WHEN {m} = 4 AND {upto} >= 2 THEN NULL ELSE o_totalprice END"
    new = " UNION ALL SELECT o_orderkey + 10000000, 5, 'N', NULL FROM orders WHERE o_orderkey % 50 = 0" if upto >= 3 else ""
    return f"SELECT o_orderkey, CASE WHEN {m} = 4 AND {upto} >= 2 THEN 1 ELSE o_custkey END AS o_custkey, {status} AS o_orderstatus, {price} AS o_totalprice FROM orders WHERE {m} <> 1{new}"


@query(_fused_sql(3))
def m1_fuse(t):
    return merge.fuse(_base(t), _changes(t), ["o_orderkey"])


@query(f"SELECT * FROM ({_fused_sql(3)}) WHERE o_orderkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
def m2_get_fuse(t):
    keys = t("lineitem").filter("l_quantity > 48").select(F.col("l_partkey").alias("o_orderkey"))
    one = lambda df: C.multi_get(df, keys, ["o_orderkey"])
    return merge.fuse(one(_base(t)), one(_changes(t)), ["o_orderkey"])


@query("SELECT o_orderkey, o_orderkey % 10 IN (1, 4) AS deleted, o_orderkey % 10 <> 1 AS live FROM orders WHERE o_orderkey % 10 BETWEEN 1 AND 4 UNION ALL SELECT o_orderkey + 10000000, FALSE, TRUE FROM orders WHERE o_orderkey % 50 = 0")
def m4_merge_increments(t):
    f = merge.fold(_changes(t), ["o_orderkey"])
    return f.select("o_orderkey", F.col("_deleted").alias("deleted"), F.col("_live").alias("live"))


@query(_fused_sql(1))
def m5_version_range(t):
    return merge.fuse(_base(t), _changes(t), ["o_orderkey"], upto=1)


@query(f"SELECT * FROM ({_fused_sql(2)}) WHERE NOT coalesce(o_totalprice < 50000, FALSE)")
def m6_compact_expire(t):
    new, rest = merge.compact(_base(t), _changes(t), ["o_orderkey"], 2, "o_totalprice < 50000")
    return new


@query(_fused_sql(3))
def m6_after_compaction(t):
    new, rest = merge.compact(_base(t), _changes(t), ["o_orderkey"], 2)
    return merge.fuse(new, rest, ["o_orderkey"])


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey")
def d20_static_read(t):
    s = Session(t("orders").sparkSession)
    return s.hinted("SELECT /*+ read_static */ o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey", _base(t), _changes(t), ["o_orderkey"])


@query(f"SELECT o_orderstatus, count(*) AS n FROM ({_fused_sql(3)}) WHERE o_orderkey > 100 GROUP BY o_orderstatus")
def d20_strong_read(t):
    s = Session(t("orders").sparkSession)
    return s.hinted("SELECT /*+ read_consistency(strong) unknown_hint(1) */ o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey > 100 GROUP BY o_orderstatus", _base(t), _changes(t), ["o_orderkey"])


@query(f"SELECT 'frozen' AS version, n_nationkey, n_name FROM ({_N}) WHERE n_regionkey = 1 UNION ALL SELECT 'now', n_nationkey, n_name || '*' FROM ({_N}) WHERE n_nationkey IN (1, 2) AND n_regionkey = 1")
def d20_sql_hints(t):
    s = _database(t, "nation")
    s.store.freeze()
    s.sql("update nation set n_name = concat(n_name, '*') where n_nationkey in (1, 2)")
    frozen = s.sql("select /*+ READ_CONSISTENCY(FROZEN) */ 'frozen' as version, n_nationkey, n_name from nation where n_regionkey = 1")
    return frozen.unionByName(s.sql("select /*+ hotspot */ 'now' as version, n_nationkey, n_name from nation where n_regionkey = 1 and n_name like '%*'"))


def _log(t) -> DataFrame:
    kind = F.when(F.col("event_type") == F.lit("view"), "a").otherwise("b")
    return t("events").select(kind.alias("table"), F.lit(1).cast("long").alias("version"), F.col("event_id").alias("seq"), F.col("user_id").alias("key"), "value", F.array(F.lit("value")).alias("_set"))


@query("SELECT event_id AS seq, user_id AS key, (user_id % 16)::INTEGER AS db_partition, (user_id % 4096)::INTEGER AS table_partition FROM events WHERE event_type <> 'view'")
def m7_replay(t):
    """The change directory, replayed as a stream into one folder per partition, in two runs from one checkpoint."""
    log = _log(t)
    spark = log.sparkSession
    top = shared(spark, "log")
    for half in (0, 1):
        log.filter(F.col("seq") % 2 == half).write.mode("append").parquet(f"{top}/changes")
        stream = changelog.only_tables(changelog.changes(spark, f"{top}/changes", log.schema), ["b"])
        changelog.replay(changelog.partitioned(stream, "key"), f"{top}/checkpoint", changelog.to_partitions(f"{top}/out"))
    return spark.read.parquet(f"{top}/out").select("seq", "key", F.col("db_partition").cast("int").alias("db_partition"), "table_partition")


@query("SELECT 'all' AS observer, event_id AS seq FROM events UNION ALL SELECT 'b', event_id FROM events WHERE event_type <> 'view'")
def m10_routed(t):
    """Two observers of one stream, the second of one table only, each fed by four router threads."""
    log = _log(t)
    spark = log.sparkSession
    top = shared(spark, "routed")
    log.write.parquet(f"{top}/changes")

    def sink(name: str):
        return lambda rows, number: rows.select("seq").write.mode("overwrite").parquet(f"{top}/{name}/part={number:012d}")

    stream = changelog.partitioned(changelog.changes(spark, f"{top}/changes", log.schema), "key")
    changelog.replay(stream, f"{top}/checkpoint", changelog.routed({"all": (sink("all"), None), "b": (sink("b"), ["b"])}))
    seen = lambda name: spark.read.parquet(f"{top}/{name}").select(F.lit(name).alias("observer"), "seq")
    return seen("all").unionByName(seen("b"))


@query("SELECT event_id AS seq, user_id AS key, c_name AS name, value FROM events LEFT JOIN customer ON user_id = c_custkey")
def m11_dense(t):
    base = t("customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    log = _log(t).withColumn("name", F.lit(None).cast("string"))
    return changelog.dense(log, base.withColumn("value", F.lit(0.0)), ["key"], ["name", "value"]).select("seq", "key", "name", "value")


@query("SELECT event_id AS seq, CASE WHEN value IS NULL THEN NULL ELSE round(value, 3) END AS value FROM events")
def m11_sparse(t):
    return changelog.sparse(_log(t), ["value"]).select("seq", F.round(F.col("changed")["value"].cast("double"), 3).alias("value"))


# --- Query shapes of advertising reports -------------------------------------------------------------------------

_EFFECT = "round(sum(l_extendedprice), 2) AS price, round(sum(l_quantity), 2) AS clicks, round(sum(l_quantity) * sum(l_quantity) / nullif(sum(l_extendedprice), 0), 6) AS effect, round(sum(l_quantity) / nullif(sum(l_tax), 0), 6) AS rate"


def _effect(s) -> DataFrame:
    s.group_by(p=("sum", "l_extendedprice"), c=("sum", "l_quantity"), x=("sum", "l_tax"))
    return s.ratio(price="round(p, 2)", clicks="round(c, 2)", effect="round(try_divide(c * c, p), 6)", rate="round(try_divide(c, x), 6)")


@query(f"SELECT l_suppkey, l_partkey, {_EFFECT} FROM lineitem GROUP BY ALL ORDER BY price DESC, l_suppkey, l_partkey LIMIT 10")
def olap_effect_top10(t):
    return _effect(scan(t("lineitem")).group_by("l_suppkey", "l_partkey")).order_by("-price", "l_suppkey", "l_partkey").limit(10).run().drop("p", "c", "x")


@query(f"SELECT l_partkey, {_EFFECT} FROM lineitem GROUP BY ALL ORDER BY price DESC, l_partkey LIMIT 10")
def olap_effect_top10_of_key(t):
    return _effect(scan(t("lineitem")).group_by("l_partkey")).order_by("-price", "l_partkey").limit(10).run().drop("p", "c", "x")


@query(f"SELECT l_partkey, {_EFFECT} FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL ORDER BY effect DESC, l_partkey")
def olap_effect_ordered(t):
    return _effect(scan(t("lineitem")).where("l_returnflag", "=", "R").group_by("l_partkey")).order_by("-effect", "l_partkey").run().drop("p", "c", "x")


@query("SELECT l_suppkey, count(*) AS parts, round(sum(q), 2) AS impression FROM (SELECT l_suppkey, l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY ALL) GROUP BY l_suppkey")
def olap_impression_nested(t):
    inner = scan(t("lineitem")).group_by("l_suppkey", "l_partkey", q=("sum", "l_quantity")).run()
    return scan(inner).group_by("l_suppkey", parts=("count", "l_partkey"), s=("sum", "q")).ratio(impression="round(s, 2)").run().drop("s")


@query(f"SELECT l_suppkey, {_EFFECT} FROM lineitem WHERE l_partkey < 50 GROUP BY ALL")
def olap_filtered_effect(t):
    return _effect(scan(t("lineitem")).where("l_partkey", "<", 50).group_by("l_suppkey")).run().drop("p", "c", "x")


@query("SELECT l_suppkey, round(sum(l_quantity), 2) AS impression FROM lineitem GROUP BY l_suppkey HAVING sum(l_quantity) > 500")
def olap_impression(t):
    return scan(t("lineitem")).group_by("l_suppkey", s=("sum", "l_quantity")).ratio(impression="round(s, 2)").having("s", ">", 500).run().drop("s")


@query(f"SELECT l_suppkey, l_returnflag, l_linestatus, {_EFFECT} FROM lineitem GROUP BY ALL")
def olap_platform_effect(t):
    return _effect(scan(t("lineitem")).group_by("l_suppkey", "l_returnflag", "l_linestatus")).run().drop("p", "c", "x")


@query(f"SELECT l_partkey, {_EFFECT} FROM lineitem WHERE l_partkey IN (1, 5, 9, 13) GROUP BY l_partkey")
def olap_several(t):
    return _effect(scan(t("lineitem")).any_of("l_partkey", [1, 5, 9, 13]).group_by("l_partkey")).run().drop("p", "c", "x")


@query(f"SELECT date_trunc('day', l_shipdate)::TIMESTAMP AS day, {_EFFECT} FROM lineitem WHERE l_suppkey = 1 GROUP BY ALL")
def olap_daily(t):
    rows = t("lineitem").withColumn("day", F.date_trunc("day", "l_shipdate").cast(t("lineitem").schema["l_shipdate"].dataType))
    return _effect(scan(rows).where("l_suppkey", "=", 1).group_by("day")).run().drop("p", "c", "x")


# --- Headline ----------------------------------------------------------------------------------------------------

FLAGSHIP = """
SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_quantity), 6) AS quantity
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity < 40 GROUP BY o_orderstatus, o_orderpriority
HAVING count(*) > 10 ORDER BY revenue DESC LIMIT 20
"""
same("flagship", FLAGSHIP)
