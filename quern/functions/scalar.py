"""Scalar functions whose semantics differ from Spark's own, as Column expressions (all JVM-side).

Arguments are columns or literals. Any NULL argument gives NULL unless a function says otherwise.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _is(x: Column, *kinds: str) -> Column:
    return F.typeof(x).isin(*kinds)


_INTEGER, _FLOATING = ("tinyint", "smallint", "int", "bigint"), ("float", "double")


def add(a, b) -> Column:
    return F.try_add(col(a), col(b))


def subtract(a, b) -> Column:
    return F.try_subtract(col(a), col(b))


def multiply(a, b) -> Column:
    return F.try_multiply(col(a), col(b))


def divide(a, b) -> Column:
    """Division of integers gives a double; by zero, NULL."""
    return F.try_divide(col(a), col(b))


def modulo(a, b) -> Column:
    """By zero, NULL."""
    return F.try_mod(col(a), col(b))


def power(a, b) -> Column:
    return F.pow(col(a).cast("double"), col(b).cast("double"))


def negate(a) -> Column:
    return -col(a)


def concat(*parts) -> Column:
    return F.concat(*[col(p).cast("string") for p in parts])


def length(s) -> Column:
    """Characters of a string; NULL for anything but a string."""
    s = col(s)
    return F.when(_is(s, "string"), F.length(s.cast("string")))


def substr(s, pos, n=None) -> Column:
    """From 1; 0 is as 1; negative from the end, and '' where that lies before the start; a negative length gives ''."""
    s, pos = col(s).cast("string"), col(pos).cast("int")
    n = F.lit(2**31 - 1) if n is None else col(n).cast("int")
    whole = F.length(s)
    out = F.when((n <= 0) | (-pos > whole), F.lit("")).otherwise(F.substring(s, pos, n))
    return F.when(s.isNull() | pos.isNull() | n.isNull(), None).otherwise(out)


def trim(s, pattern: str = " ", side: str = "both") -> Column:
    """Strip whole copies of the pattern, again and again, from the named side (both, leading, trailing)."""
    s = col(s).cast("string")
    if not pattern:
        return s
    quoted = "(?:" + re.sub(r"([^A-Za-z0-9 ])", r"\\\1", pattern) + ")+"
    if side in ("both", "leading"):
        s = F.regexp_replace(s, "^" + quoted, "")
    if side in ("both", "trailing"):
        s = F.regexp_replace(s, quoted + r"\z", "")
    return s


def hex_of(x) -> Column:
    """Lower-case digits of an integer, or of a string's bytes; NULL for floating numbers."""
    x = col(x)
    return F.when(_is(x, *_FLOATING), None).when(_is(x, *_INTEGER), F.lower(F.hex(x.try_cast("long")))).otherwise(F.lower(F.hex(x.cast("string"))))


def unhex(x) -> Column:
    """The string whose bytes the digits name; NULL for invalid or odd digits, and for numbers."""
    x = col(x)
    return F.when(_is(x, "string") & x.cast("string").rlike("^(?:[0-9A-Fa-f]{2})*$"), F.decode(F.unhex(x.cast("string")), "UTF-8"))


def ip2int(s) -> Column:
    """A dotted quad's bytes, the first one lowest; NULL unless it is four numbers up to 255."""
    s = col(s).cast("string")
    octet = [F.split(s, r"\.")[i].try_cast("long") for i in range(4)]
    value = reduce(lambda a, b: a + b, [o * 256**i for i, o in enumerate(octet)])
    ok = s.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$")
    return F.when(ok, F.when(reduce(lambda a, b: a & b, [o <= 255 for o in octet]), value))


def int2ip(n) -> Column:
    """The inverse of ip2int for the low 32 bits."""
    n = col(n).cast("long")
    parts = [F.shiftrightunsigned(n, 8 * i).bitwiseAND(F.lit(255)).cast("string") for i in range(4)]
    return F.when(n.isNotNull(), F.concat_ws(".", *parts))


def _extreme(pick, args) -> Column:
    args = [col(a) for a in args]
    if len(args) == 1:
        return args[0]
    return F.when(reduce(lambda a, b: a | b, [a.isNull() for a in args]), None).otherwise(pick(*args))


def greatest(*args) -> Column:
    """NULL if any argument is."""
    return _extreme(F.greatest, args)


def least(*args) -> Column:
    return _extreme(F.least, args)


def as_number(s) -> Column:
    """How a string compares with numbers: as the number it spells, else as 0."""
    s = col(s)
    return F.when(s.isNotNull(), F.coalesce(s.try_cast("double"), F.lit(0.0)))


def cast_int(x) -> Column:
    """A string's leading digits; microseconds of a time; otherwise an ordinary cast."""
    x = col(x)
    text = F.coalesce(F.regexp_extract(x.cast("string"), r"^\s*([+-]?\d+)", 1).try_cast("long"), F.when(x.isNotNull(), F.lit(0).cast("long")))
    return F.when(_is(x, "string"), text).when(_is(x, "timestamp", "timestamp_ntz"), F.unix_micros(x.try_cast("timestamp"))).otherwise(x.try_cast("long"))


def truth(x) -> Column:
    """A number as a condition: true unless 0."""
    return col(x) != 0
