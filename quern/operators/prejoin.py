"""Declared lookup joins: a table's rows with the columns that another table, found by its whole key, fills."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.catalog import Lookup


def prejoin(left: DataFrame, right: DataFrame, lookup: Lookup, right_key: list[str]) -> DataFrame:
    """left with the lookup's columns, NULL where no row has the key; the lookup must give right's whole key.

    At most one row matches, so no row of left is repeated; Spark broadcasts right where it is small enough.
    """
    if {theirs for _, theirs in lookup.keys} != set(right_key):
        raise ValueError(f"a lookup needs the whole key {right_key}")
    side = right.select(*[F.col(theirs).alias(f"_k{i}") for i, (_, theirs) in enumerate(lookup.keys)], *[F.col(theirs).alias(f"_v{i}") for i, (_, theirs) in enumerate(lookup.columns)])
    match = reduce(lambda a, b: a & b, [F.col(mine) == F.col(f"_k{i}") for i, (mine, _) in enumerate(lookup.keys)])
    filled = {mine: i for i, (mine, _) in enumerate(lookup.columns)}
    both = left.drop(*filled).join(side, match, "left")
    order = [*left.columns, *[c for c in filled if c not in left.columns]]
    return both.select(*[F.col(f"_v{filled[c]}").alias(c) if c in filled else F.col(c) for c in order])


def timed_prejoin(left: DataFrame, right: DataFrame, on: list[str], *, created: str, modified: str, columns: list[str]) -> DataFrame:
    """The older lookup: besides filling columns, the time of creation becomes the lesser and that of change the greater of both rows'.

    Where left's time is NULL, or no row matches, left's time stays.
    """
    side = right.select(*on, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in {created, modified, *columns}])
    both = left.join(side, on, "left")

    def pick(c: str):
        if c in (created, modified):
            merged = F.least(c, f"_{c}") if c == created else F.greatest(c, f"_{c}")
            return F.when(F.col("_hit") & F.col(c).isNotNull(), merged).otherwise(F.col(c)).alias(c)
        return (F.col(f"_{c}") if c in columns else F.col(c)).alias(c)

    return both.select(*[pick(c) for c in [*left.columns, *[c for c in columns if c not in left.columns]]])
