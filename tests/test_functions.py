"""Edge cases of scalar functions and predicates, on literals."""

import datetime

import pytest
from pyspark.sql import functions as F

from quern.functions import predicates as P
from quern.functions import scalar as S


def cases():
    null = F.lit(None)
    TEXT, LONG = null.cast("string"), null.cast("long")
    return [
        (S.divide(1, 2), 0.5), (S.divide(1, 0), None), (S.divide(LONG, 2), None), (S.modulo(7, 0), None), (S.modulo(7, 4), 3),
        (S.add(1, LONG), None), (S.add(F.lit(2**63 - 1), 1), None), (S.power(2, 10), 1024.0), (S.negate(5), -5), (S.concat("a", 1, "b"), "a1b"), (S.concat("a", TEXT), None),
        (S.length("abc"), 3), (S.length(""), 0), (S.length(12), None), (S.length(TEXT), None),
        (S.substr("hello", 0, 2), "he"), (S.substr("hello", 1, 2), "he"), (S.substr("hello", -3, 2), "ll"), (S.substr("hello", -6, 10), ""), (S.substr("hello", 2), "ello"),
        (S.substr("hello", 2, -1), ""), (S.substr("hello", 9, 2), ""), (S.substr(TEXT, 1, 2), None), (S.substr("hello", 1, LONG), None), (S.substr(12345, 2, 2), "23"),
        (S.trim("ababa", "aba"), "ba"), (S.trim("  x "), "x"), (S.trim("xxaxx", "x", "leading"), "axx"), (S.trim("xxaxx", "x", "trailing"), "xxa"), (S.trim("a.b.", "."), "a.b"), (S.trim("a\n", "a"), "\n"), (S.trim(TEXT, "x"), None), (S.trim("abc", ""), "abc"),
        (S.hex_of(255), "ff"), (S.hex_of("aZ"), "615a"), (S.hex_of(1.5), None), (S.hex_of(TEXT), None), (S.hex_of(""), ""),
        (S.unhex("615a"), "aZ"), (S.unhex("6"), None), (S.unhex("0g"), None), (S.unhex(61), None), (S.unhex(""), ""),
        (S.ip2int("0.0.1.0"), 65536), (S.ip2int("256.0.0.0"), None), (S.ip2int("1.0.0"), None), (S.ip2int(TEXT), None), (S.ip2int("255.255.255.255"), 2**32 - 1),
        (S.int2ip(256), "0.1.0.0"), (S.int2ip(4294967296), "0.0.0.0"), (S.int2ip(LONG), None), (S.int2ip(-1), "255.255.255.255"),
        (S.greatest(1, 10, 3), 10), (S.greatest(1, LONG), None), (S.least(2, 1), 1), (S.least(LONG, 1), None), (S.greatest(4), 4),
        (S.greatest(S.as_number("test"), 100), 100.0), (S.as_number("2.5"), 2.5), (S.as_number(TEXT), None),
        (S.cast_int("1970-01-01 08:00:12"), 1970), (S.cast_int("x"), 0), (S.cast_int("-7a"), -7), (S.cast_int(TEXT), None), (S.cast_int(2.7), 2),
        (S.cast_int(F.lit(datetime.datetime(1970, 1, 1, 0, 0, 1, tzinfo=datetime.timezone.utc))), 1_000_000),
        (S.truth(2), True), (S.truth(0), False), (S.truth(LONG), None),
        (P.in_list(LONG, 1, LONG), True), (P.in_list(1, 2, LONG), None), (P.in_list(1, 2, 3), False), (P.in_list(2, 2, LONG), True), (P.in_list(LONG, 1), None),
        (P.not_in_list(1, 2), True), (P.not_in_list(1, 2, LONG), None), (P.not_in_list(LONG, LONG), False),
        (P.row_in((1, 2), (1, 3), (1, 2)), True), (P.row_in((1, 2), (2, 1)), False), (P.row_in((1, LONG), (1, 2)), None), (P.row_in((1, LONG), (2, 2)), False),
        (P.like("", ""), True), (P.like("abcd", ""), False), (P.like("abcd", "a%d"), True), (P.like("abcd", "a_d"), False), (P.like(5, "5"), None), (P.like(TEXT, "a"), None),
        (P.legacy_like("abcd", ""), True), (P.legacy_like("abcd", "bc"), True), (P.legacy_like("abcd", "x"), False),
        (P.is_true(LONG), False), (P.is_true(3), True), (P.is_true(0), False), (P.is_true(F.lit(True)), True),
    ]


def test_values(spark):
    wanted = cases()
    row = spark.range(1).select(*[c.alias(f"x{i}") for i, (c, _) in enumerate(wanted)]).first()
    assert {i: row[i] for i, (_, v) in enumerate(wanted) if row[i] != v} == {}


def test_row_widths(spark):
    with pytest.raises(ValueError):
        P.row_in((1, 2), (1,))
