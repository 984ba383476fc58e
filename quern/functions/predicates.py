"""Predicates whose NULL rules differ from Spark's own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.scalar import col


def in_list(probe, *items) -> Column:
    """IN, where NULL matches NULL; without a match NULL if the probe or an item is NULL, else false."""
    probe, items = col(probe), [col(i) for i in items]
    match = reduce(lambda a, b: a | b, [probe.eqNullSafe(i) for i in items])
    unknown = reduce(lambda a, b: a | b, [i.isNull() for i in items], probe.isNull())
    return F.when(match, F.lit(True)).when(~unknown, F.lit(False))


def not_in_list(probe, *items) -> Column:
    return ~in_list(probe, *items)


def row_in(probe: tuple, *rows: tuple) -> Column:
    """Row IN: a row matches where all its places do; rows of another width are an error."""
    if any(len(r) != len(probe) for r in rows):
        raise ValueError(f"every row must have {len(probe)} values")
    every = [reduce(lambda a, b: a & b, [col(p) == col(v) for p, v in zip(probe, r, strict=True)]) for r in rows]
    return reduce(lambda a, b: a | b, every)


def like(s, pattern) -> Column:
    """% and _; NULL where either operand is not a string."""
    s, pattern = col(s), col(pattern)
    strings = (F.typeof(s) == "string") & (F.typeof(pattern) == "string")
    return F.when(strings, F.like(s.cast("string"), pattern.cast("string")))


def legacy_like(s, part) -> Column:
    """Substring search; an empty part is always found."""
    return F.contains(col(s).cast("string"), col(part).cast("string"))


def is_true(x) -> Column:
    """IS TRUE of a boolean or a number."""
    x = col(x)
    return F.coalesce(F.when(F.typeof(x) == "boolean", x.cast("boolean")).otherwise(x.cast("double") != 0), F.lit(False))
