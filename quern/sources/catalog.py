"""Tables: their declared schema and options, Parquet and delimited readers and writers."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: Every integer keyword is a 64-bit integer; dates and times are all timestamps.
TYPES = {
    **dict.fromkeys(("tinyint", "smallint", "mediumint", "int", "integer", "bigint"), T.LongType()),
    "float": T.FloatType(),
    **dict.fromkeys(("double", "real", "double precision"), T.DoubleType()),
    **dict.fromkeys(("decimal", "numeric"), T.DecimalType(38, 10)),
    **dict.fromkeys(("bool", "boolean"), T.BooleanType()),
    **dict.fromkeys(("date", "time", "datetime", "timestamp", "createtime", "modifytime"), T.TimestampType()),
    **dict.fromkeys(("varchar", "char", "character", "varbinary"), T.StringType()),
    "binary": T.StringType(),
}


def type_of(keyword: str) -> T.DataType:
    """The type of a SQL type keyword; its length or precision in brackets is read for decimals only."""
    name, _, rest = keyword.strip().lower().partition("(")
    if name.strip() in ("decimal", "numeric") and rest:
        p, _, s = rest.rstrip(") ").partition(",")
        return T.DecimalType(min(int(p), 38), int(s or 0))
    return TYPES[name.strip()]


@dataclass(frozen=True)
class Lookup:
    """A declared lookup join: our columns that hold the other table's whole key, and the columns it fills."""

    table: str
    keys: tuple[tuple[str, str], ...]
    columns: tuple[tuple[str, str], ...]


def parse_join_info(text: str) -> Lookup:
    """'[left$right,...]%table:column$column,...'"""
    m = re.fullmatch(r"\s*\[([^\]]*)\]%([^:]+):(.*)", text)
    if not m:
        raise ValueError(f"not a join declaration: {text!r}")
    pairs = lambda s: tuple(tuple(p.strip() for p in x.split("$", 1)) for x in s.split(",") if x.strip())
    if any(len(p) != 2 for p in (*pairs(m[1]), *pairs(m[3]))):
        raise ValueError(f"each pair needs two names: {text!r}")
    return Lookup(m[2].strip(), pairs(m[1]), pairs(m[3]))


@dataclass(frozen=True)
class Table:
    """A declared table: columns with their types, the key, a lookup join, an expiry predicate, and comments."""

    name: str
    columns: tuple[tuple[str, str], ...]
    key: tuple[str, ...] = ()
    join_info: str | None = None
    expire_info: str | None = None
    created: str | None = None  # a column that holds the time of insertion
    modified: str | None = None  # a column that holds the time of the last change
    codec: str = "snappy"
    options: dict = field(default_factory=dict)
    defaults: dict = field(default_factory=dict)  # by column, as SQL literals

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, type_of(k), n not in self.key, {"key": self.key.index(n) + 1} if n in self.key else {}) for n, k in self.columns])

    @property
    def lookup(self) -> Lookup | None:
        return parse_join_info(self.join_info) if self.join_info else None

    @property
    def writable(self) -> list[str]:
        """Columns that statements may write: not those that a lookup fills."""
        filled = {mine for mine, _ in self.lookup.columns} if self.lookup else set()
        return [n for n, _ in self.columns if n not in filled]

    def add(self, name: str, kind: str) -> Table:
        if name in dict(self.columns):
            raise ValueError(f"column {name} exists")
        return replace(self, columns=(*self.columns, (name, kind)))

    def drop(self, name: str) -> Table:
        if name in self.key or name not in dict(self.columns):
            raise ValueError(f"column {name} can't be dropped")
        return replace(self, columns=tuple(c for c in self.columns if c[0] != name))

    def rename(self, old: str, new: str) -> Table:
        return replace(self, columns=tuple((new if n == old else n, k) for n, k in self.columns), key=tuple(new if n == old else n for n in self.key))


class Catalog:
    """Declared tables by name, and where their rows are."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables, self.paths = spark, {}, {}

    def create(self, table: Table, path: str | None = None, *, if_not_exists: bool = False) -> None:
        if table.name in self.tables and not if_not_exists:
            raise ValueError(f"table {table.name} exists")
        self.tables.setdefault(table.name, table)
        if path:
            self.paths.setdefault(table.name, path)

    def alter(self, table: Table) -> None:
        if table.name not in self.tables:
            raise ValueError(f"table {table.name} does not exist")
        self.tables[table.name] = table

    def drop(self, name: str, *, if_exists: bool = False) -> None:
        if name not in self.tables and not if_exists:
            raise ValueError(f"table {name} does not exist")
        self.tables.pop(name, None)
        self.paths.pop(name, None)

    def read(self, name: str) -> DataFrame:
        """The rows of a table in its declared schema; a column added since they were written is NULL."""
        t = self.tables[name]
        stored = self.spark.read.parquet(self.paths[name])
        return stored.select(*[(F.col(f.name).cast(f.dataType) if f.name in stored.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in t.schema])

    def all_tables(self) -> DataFrame:
        """System table: one row for each declared table."""
        rows = [(n, len(t.columns), ",".join(t.key), t.join_info, t.expire_info) for n, t in sorted(self.tables.items())]
        return self.spark.createDataFrame(rows, "table_name string, column_num long, rowkey string, join_info string, expire_info string")

    def all_columns(self) -> DataFrame:
        """System table: one row for each column."""
        rows = [(n, c, i, t.key.index(c) + 1 if c in t.key else 0, k) for n, t in sorted(self.tables.items()) for i, (c, k) in enumerate(t.columns, 1)]
        return self.spark.createDataFrame(rows, "table_name string, column_name string, position long, rowkey_id long, data_type string")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, names: Iterable[str] = TABLES) -> None:
    for name in names:
        load(spark, sf_dir, name).createOrReplaceTempView(name)


def multi_get(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of the listed keys: a semi join, which Spark broadcasts if the list is small."""
    return df.join(keys.select(*on).distinct(), on, "left_semi")


def point_get(df: DataFrame, **key) -> DataFrame:
    """Rows of one key; equality reaches the Parquet scan as a pushed filter."""
    for name, value in key.items():
        df = df.filter(F.col(name) == value)
    return df


def key_range(df: DataFrame, column: str, low=None, high=None, *, low_in: bool = True, high_in: bool = False, reverse: bool = False, order: bool = False) -> DataFrame:
    """Rows of a key range, in key order if asked (reverse: descending)."""
    if low is not None:
        df = df.filter(F.col(column) >= low if low_in else F.col(column) > low)
    if high is not None:
        df = df.filter(F.col(column) <= high if high_in else F.col(column) < high)
    return df.orderBy(F.desc(column) if reverse else F.asc(column)) if order or reverse else df


NOP_MASK = "_set"


#: What stands for the signs that a field can't hold as they are; the escape is doubled first.
ESCAPES = (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"))


def _escaped(c: Column, sep: str) -> Column:
    for sign, written in ESCAPES:
        c = F.replace(c, F.lit(sign), F.lit(written))
    return F.replace(c, F.lit(sep), F.lit("\\s"))


def _plain(c: Column, sep: str) -> Column:
    """The field that was written: pairs that begin with the escape are read from left to right."""
    whole = F.replace(c, F.lit("\\\\"), F.lit("\x00"))  # a doubled escape stands for itself
    for sign, written in (("\n", "\\n"), ("\r", "\\r"), (sep, "\\s")):
        whole = F.replace(whole, F.lit(written), F.lit(sign))
    return F.replace(whole, F.lit("\x00"), F.lit("\\"))


def read_delimited(
    spark: SparkSession, path: str, table: Table, *, sep: str = "\x01", line: str = "\n", null: str = "\\N", nop: str | None = None, columns: list[str] | None = None,
    title: bool = False, escaped: bool = False, keep_bad: bool = False,
) -> DataFrame:
    """Text rows, one a record, as the table's columns; `columns` names the fields in file order (None skips one).

    A field that is the null flag is NULL. With a nop flag, a field that is it leaves its column unchanged: the result
    then has `_set`, the names of the columns that each row sets, as merge-on-read expects it. With a title, records equal to the first one
    of the path are no rows. escaped reads what write_delimited escapes. A record that has not as many fields, lacks a key, or has a field that is not
    of its column's type is an error; with keep_bad it is a row with its text in `_bad`.
    """
    names = columns or [n for n, _ in table.columns]
    kinds = {f.name: f.dataType for f in table.schema}
    raw = spark.read.option("lineSep", line).text(path)
    if title:
        first = raw.first()
        raw = raw.filter(F.col("value") != F.lit(first[0] if first else ""))
    parts = F.split(F.col("value"), re.escape(sep), -1)
    given = [n for n in names if n]
    fields = raw.select("value", F.size(parts).alias("_n"), *[F.get(parts, i).alias(n) for i, n in enumerate(names) if n])
    blank = lambda n: F.col(n).isNull() | (F.col(n) == null) | ((F.col(n) == nop) if nop is not None else F.lit(False))
    text = lambda n: F.when(~blank(n), _plain(F.col(n), sep) if escaped else F.col(n))
    bad = F.col("_n") != len(names)
    for n in given:
        bad |= text(n).isNotNull() & text(n).try_cast(kinds[n]).isNull()
        if n in table.key:
            bad |= blank(n)
    out = [text(n).try_cast(kinds[n]).alias(n) for n in given]
    if nop is not None:
        out.append(F.array_compact(F.array(*[F.when(F.col(n) != nop, F.lit(n)) for n in given])).alias(NOP_MASK))
    if keep_bad:
        return fields.select(*out, F.when(F.coalesce(bad, F.lit(True)), F.col("value")).alias("_bad"))
    fault = F.raise_error(F.concat(F.lit("not a record of "), F.lit(table.name), F.lit(": "), F.col("value")))
    return fields.select(*[F.when(F.coalesce(bad, F.lit(True)), fault.cast(kinds[n])).otherwise(c).alias(n) if n in kinds else c for n, c in zip([*given, *([NOP_MASK] if nop is not None else [])], out, strict=True)])


def rejected(rows: DataFrame) -> DataFrame:
    """The records that read_delimited(keep_bad=True) could not read, as text."""
    return rows.filter("_bad IS NOT NULL").select(F.col("_bad").alias("value"))


def write_delimited(
    df: DataFrame, path: str, *, sep: str = "\x01", line: str = "\n", null: str = "\\N", columns: list[str] | None = None, where: Column | None = None, limit: int | None = None, escaped: bool = False
) -> None:
    """Chosen columns and rows as text, one record a row. escaped writes separators, line ends and backslashes within fields so that
    read_delimited(escaped=True) gives them back; without it a value that holds any of the separators is an error."""
    if where is not None:
        df = df.filter(where)
    if limit is not None:
        df = df.limit(limit)
    names = columns or df.columns
    out = []
    for n in names:
        c = F.col(n).cast("string")
        if escaped:
            c = _escaped(c, sep)
        else:
            c = F.when(c.contains(sep) | c.contains(line), F.raise_error(F.concat(F.lit("a separator in a value: "), c))).otherwise(c)
        out.append(F.coalesce(c, F.lit(null)))
    df.select(F.concat_ws(sep, *out).alias("value")).write.mode("overwrite").option("lineSep", line).text(path)


def write_base(df: DataFrame, path: str, key: list[str], *, codec: str = "snappy", files: int | None = None, bloom: bool = False) -> None:
    """A base version: range-partitioned and sorted by key, so that key ranges skip files and row groups."""
    by = df.repartitionByRange(*([files] if files else []), *key).sortWithinPartitions(*key)
    w = by.write.mode("overwrite").option("compression", codec)
    if bloom:
        for k in key:
            w = w.option(f"parquet.bloom.filter.enabled#{k}", "true")
    w.parquet(path)
