"""Relational operators as DataFrame compositions; the physical strategy is left to Catalyst and AQE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

JOINS = ("inner", "left", "right", "full", "left_semi", "right_semi", "left_anti", "right_anti")


def join(left: DataFrame, right: DataFrame, on: Column | list[str], how: str = "inner") -> DataFrame:
    """All eight join types, with any condition; NULL keys never match. The right-hand types give the right side's rows."""
    if how not in JOINS:
        raise ValueError(f"unknown join type {how}")
    if how in ("right_semi", "right_anti"):
        return right.join(left, on, how.replace("right", "left"))
    return left.join(right, on, how)


AGGREGATES = {"max": F.max, "min": F.min, "sum": F.sum, "count": F.count, "avg": F.avg}
DISTINCT = {"max": F.max, "min": F.min, "sum": F.sum_distinct, "count": F.count_distinct, "avg": lambda c: F.sum_distinct(c) / F.count_distinct(c)}


def aggregate(name: str, c: Column | str = "*", *, distinct: bool = False) -> Column:
    """One of MAX, MIN, SUM, COUNT, AVG, of distinct values if asked; COUNT of * counts rows."""
    if isinstance(c, str):
        c = F.lit(1) if c == "*" else F.col(c)
    return (DISTINCT if distinct else AGGREGATES)[name.lower()](c)


def group(df: DataFrame, keys: list, aggs: dict[str, Column], *, having: Column | None = None, first: list[str] = (), by: list[str] = ()) -> DataFrame:
    """Grouped (or, without keys, scalar) aggregates under their names; `first` adds columns outside the keys, with the values of each group's first row in the order of `by`."""
    if first and not by:
        raise ValueError("the first row of a group needs an order")
    row = F.min_by(F.struct(*first), F.struct(*by)) if first else None
    out = df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()], *([row.alias("_first")] if first else []))
    out = out.select(*[c for c in out.columns if c != "_first"], *[F.col("_first")[c].alias(c) for c in first]) if first else out
    return out if having is None else out.filter(having)


def set_operation(kind: str, left: DataFrame, right: DataFrame, *, every: bool = False) -> DataFrame:
    """UNION, INTERSECT or EXCEPT, of distinct rows unless `every`; columns go by place and are named as the left ones."""
    if len(left.columns) != len(right.columns):
        raise ValueError("the branches of a set operation must have as many columns")
    if kind == "union":
        out = left.union(right)
        return out if every else out.distinct()
    if kind == "intersect":
        return left.intersectAll(right) if every else left.intersect(right)
    if kind == "except":
        return left.exceptAll(right) if every else left.subtract(right)
    raise ValueError(f"unknown set operation {kind}")


def sort(df: DataFrame, *by) -> DataFrame:
    """By names, columns, or ordinals from 1 (negative: descending); NULL is lowest."""
    out = []
    for b in by:
        if isinstance(b, int):
            if not 1 <= abs(b) <= len(df.columns):
                raise ValueError(f"unknown column {b} in ORDER BY")
            c = F.col(df.columns[abs(b) - 1])
            b = c.desc_nulls_last() if b < 0 else c.asc_nulls_first()
        out.append(b)
    return df.orderBy(*out)


def limit(df: DataFrame, n: int | None = None, offset: int = 0) -> DataFrame:
    """At most n rows after the first `offset`; None or -1 sets no limit, anything lower is an error."""
    if (n is not None and n < -1) or offset < 0:
        raise ValueError("limit and offset can't be negative")
    df = df.offset(offset) if offset else df
    return df if n is None or n == -1 else df.limit(n)


def top(df: DataFrame, n: int, *by, offset: int = 0) -> DataFrame:
    """Sort and limit in one: each task keeps its n first rows only."""
    return limit(sort(df, *by), n, offset)


def top_of_each(df: DataFrame, keys: list[str], n: int, *by) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).filter(F.col("_n") <= n).drop("_n")
