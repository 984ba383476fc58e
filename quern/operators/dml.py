"""Data changes as new snapshots: each statement returns the table's next rows and how many it affected.

Nothing is changed in place; write_snapshot() makes a snapshot the current one by a single rename, so
readers see the old or the new rows. Statements as text, transactions and increments are in quern.plans.session.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.sources.catalog import Table


class KeyExists(ValueError):
    """A row with that key is there already."""


@dataclass
class Change:
    """The rows after a statement and, when asked for, the number of rows that it affected."""

    rows: DataFrame
    touched: DataFrame

    def row_count(self) -> int:
        return self.touched.count()


def _aligned(new: DataFrame, table: Table, columns: list[str] | None) -> DataFrame:
    names = columns or new.columns
    if len(set(names)) != len(names):
        raise ValueError("a column is named twice")
    if len(names) != len(new.columns):
        raise ValueError("as many values as columns are needed")
    new = new.toDF(*names)
    locked = set(names) - set(table.writable)
    if locked:
        raise ValueError(f"columns {sorted(locked)} are filled by a lookup and can't be written")
    if not set(table.key) <= set(names):
        raise ValueError(f"the key {table.key} must be given")
    out = []
    for f in table.schema:
        if f.name in (table.created, table.modified) and f.name not in names:
            out.append(F.current_timestamp().cast(f.dataType).alias(f.name))
        else:
            out.append((F.col(f.name) if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name))
    return new.select(*out)


def absent(rows: DataFrame, new: DataFrame, key: list[str]) -> bool:
    """Whether no key of new is in rows, nor twice in new."""
    twice = new.groupBy(*key).count().filter("count > 1").select(*key)
    return new.select(*key).join(rows, key, "left_semi").unionByName(twice).isEmpty()


def insert(rows: DataFrame, new: DataFrame, table: Table, columns: list[str] | None = None) -> Change:
    """Append; KeyExists if a key is there or given twice."""
    new = _aligned(new, table, columns)
    if not absent(rows, new, list(table.key)):
        raise KeyExists(f"a row of {table.name} has that key")
    return Change(rows.unionByName(new), new)


def insert_new(rows: DataFrame, new: DataFrame, table: Table, columns: list[str] | None = None) -> Change:
    """Append if no key exists, else nothing at all."""
    new = _aligned(new, table, columns)
    return Change(rows.unionByName(new), new) if absent(rows, new, list(table.key)) else Change(rows, new.limit(0))


def replace(rows: DataFrame, new: DataFrame, table: Table, columns: list[str] | None = None, order: str | None = None) -> Change:
    """Whole rows, by key; columns that aren't given become NULL. Of rows of one key that with the greatest `order` (a column of new that is
    not written) wins; without it a key must not be given twice."""
    if order:
        names = columns or [c for c in new.columns if c != order]
        placed = new.select(*[c for c in new.columns if c != order], order).toDF(*names, "_place")
        winner = Window.partitionBy(*table.key).orderBy(F.desc("_place"))
        last = _aligned(placed.withColumn("_n", F.row_number().over(winner)).filter("_n = 1").drop("_n", "_place"), table, names)
    else:
        last = _aligned(new, table, columns)
        if not last.groupBy(*table.key).count().filter("count > 1").isEmpty():
            raise ValueError("a key is given twice; name the column that orders its rows")
    match = [rows[k].eqNullSafe(last[k]) for k in table.key]
    return Change(rows.join(last, match, "left_anti").unionByName(last), last)


def _where(where: Column | str) -> Column:
    return F.coalesce(F.expr(where) if isinstance(where, str) else where, F.lit(False))


def update(rows: DataFrame, assignments: dict[str, Column], where: Column | str, table: Table) -> Change:
    """Set columns of the rows for which `where` is true; keys and looked-up columns can't be set."""
    locked = [c for c in assignments if c in table.key or c not in table.writable]
    if locked:
        raise ValueError(f"columns {locked} can't be set")
    hit = _where(where)
    kinds = {f.name: f.dataType for f in rows.schema}
    values = dict(assignments)
    if table.modified and table.modified not in values:
        values[table.modified] = F.current_timestamp()
    out = [F.when(hit, values[c].cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns]
    return Change(rows.select(*out), rows.filter(hit))


def delete(rows: DataFrame, where: Column | str) -> Change:
    hit = _where(where)
    return Change(rows.filter(~hit), rows.filter(hit))


def when(statement: Change, condition: Callable[[int], bool], current: DataFrame, inner: Change | None = None) -> Change:
    """The statement, if the condition holds for the number of rows that the inner statement affects; else no change.

    inner defaults to the statement itself. As the inner one takes effect only with its outer one, nesting is a chain of calls.
    """
    counted = (inner or statement).row_count()
    return statement if condition(counted) else Change(current, statement.touched.limit(0))


def write_snapshot(df: DataFrame, root: str, version: int) -> str:
    """Write a version under root; it becomes current by one rename of its whole folder. A version that is there already is an error."""
    fs, p = _files(df.sparkSession, root)
    draft, path = f"{root.rstrip('/')}/draft-{uuid.uuid4().hex}", f"{root.rstrip('/')}/v{version:012d}"
    df.write.parquet(draft)
    if fs.exists(p(path)) or not fs.rename(p(draft), p(path)):
        fs.delete(p(draft), True)
        raise FileExistsError(f"{path} is there already")
    return path


def read_snapshot(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The highest (or a given) version."""
    fs, p = _files(spark, root)
    if version is None:
        names = [f.getPath().getName() for f in fs.listStatus(p(root))]
        name = max((n for n in names if n.startswith("v")), default=None)
        if name is None:
            raise FileNotFoundError(f"no version under {root}")
    else:
        name = f"v{version:012d}"
    return spark.read.parquet(f"{root.rstrip('/')}/{name}")


def _files(spark: SparkSession, root: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path
