"""Merge on read: base rows fused with keyed changes, compaction, and expiry.

A change row has the key, values, and:

- `_version` and `_seq`, its place in the order of changes;
- `_op`: 'upsert' or 'delete';
- `_set`: the names of the columns that an upsert sets. A column that it doesn't name is left unchanged, which differs from being set to NULL.

All changes of a key are folded to one before base rows are touched: each column's last setter after the last delete
wins. That is one aggregation with partial sums before its shuffle, so a key with very many changes costs one row per
task. Base is then the streamed side of left joins with the folded changes: it is not shuffled where these are small enough to be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = ("_version", "_seq")
META = (*ORDER, "_op", "_set")


def version_range(changes: DataFrame, after: int | None = None, upto: int | None = None) -> DataFrame:
    """Changes of the versions (after, upto]; None leaves that end open."""
    if after is not None:
        changes = changes.filter(F.col("_version") > after)
    if upto is not None:
        changes = changes.filter(F.col("_version") <= upto)
    return changes


def fold(changes: DataFrame, key: list[str]) -> DataFrame:
    """One row for each changed key: `_deleted` (a delete came), `_live` (an upsert came after it), and per column its value and whether it is set since."""
    values = [c for c in changes.columns if c not in key and c not in META]
    at = F.struct(*ORDER)
    cut = changes.groupBy(*key).agg(F.max(F.when(F.col("_op") == "delete", at)).alias("_cut"), *[_last_set(c, at) for c in values], F.max(F.when(F.col("_op") == "upsert", at)).alias("_up"))
    since = lambda c: F.col(c)["at"].isNotNull() & (F.col("_cut").isNull() | (F.col(c)["at"] > F.col("_cut")))
    out = [F.col(k) for k in key] + [F.col("_cut").isNotNull().alias("_deleted"), (F.col("_up").isNotNull() & (F.col("_cut").isNull() | (F.col("_up") > F.col("_cut")))).alias("_live")]
    for c in values:
        out += [F.when(since(f"_last_{c}"), F.col(f"_last_{c}")["value"]).alias(c), F.coalesce(since(f"_last_{c}"), F.lit(False)).alias(f"_set_{c}")]
    return cut.select(*out)


def _last_set(c: str, at: Column) -> Column:
    """The last upsert that sets c: its place and value (which may be NULL)."""
    hit = (F.col("_op") == "upsert") & F.array_contains("_set", c)
    return F.max_by(F.when(hit, F.struct(at.alias("at"), F.col(c).alias("value"))), F.when(hit, at)).alias(f"_last_{c}")


def fuse(base: DataFrame, changes: DataFrame, key: list[str], *, after: int | None = None, upto: int | None = None) -> DataFrame:
    """base as it is after the changes of (after, upto].

    A deleted key goes, unless an upsert follows: then its row holds what is set since, NULL elsewhere. A key that only
    changes have becomes a row. Columns of base that changes lack stay. A NULL key is a key like others.
    """
    folded = fold(version_range(changes, after, upto), key)
    d = folded.select(F.lit(True).alias("_d_hit"), *[F.col(c).alias(f"_d_{c}") for c in folded.columns])
    match = [F.col(k).eqNullSafe(F.col(f"_d_{k}")) for k in key]
    value = lambda c: F.when(F.col(f"_d__set_{c}"), F.col(f"_d_{c}"))  # noqa: E731  what a change sets, or NULL
    hit = F.coalesce("_d_hit", F.lit(False))
    old = base.join(d, match, "left").filter(~hit | F.col("_d__live") | ~F.col("_d__deleted"))
    out = []
    for c in base.columns:
        was = F.when(hit & F.col("_d__deleted"), None).otherwise(F.col(c))
        out.append(F.col(c) if c in key else (F.when(hit & F.col(f"_d__set_{c}"), F.col(f"_d_{c}")).otherwise(was) if c in folded.columns else was).alias(c))
    # keys that only changes have: those of base that changed are found first, as few as the changes
    known = base.select(*key).join(d, match, "left_semi").select(*[F.col(k).alias(f"_b_{k}") for k in key])
    new = d.filter("_d__live").join(known, [F.col(f"_d_{k}").eqNullSafe(F.col(f"_b_{k}")) for k in key], "left_anti")
    kinds = {f.name: f.dataType for f in base.schema}
    fresh = [(F.col(f"_d_{c}") if c in key else value(c) if c in folded.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in base.columns]
    return old.select(*out).unionByName(new.select(*fresh))


def merge_changes(*many: DataFrame) -> DataFrame:
    """Several increments as one; order is theirs by version and sequence."""
    out = many[0]
    for m in many[1:]:
        out = out.unionByName(m, allowMissingColumns=True)
    return out


def expire(df: DataFrame, predicate: str | Column | None) -> DataFrame:
    """Rows but those for which the table's expiry predicate is true."""
    if predicate is None:
        return df
    predicate = F.expr(predicate) if isinstance(predicate, str) else predicate
    return df.filter(~F.coalesce(predicate, F.lit(False)))


def compact(base: DataFrame, changes: DataFrame, key: list[str], upto: int, expire_info: str | Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(the new base version, the changes that are left): a frozen increment merged, expired rows dropped."""
    return expire(fuse(base, changes, key, upto=upto), expire_info), version_range(changes, after=upto)


def read(base: DataFrame, changes: DataFrame, key: list[str], *, static: bool = False, consistency: str = "strong", version: int | None = None) -> DataFrame:
    """What a query with these hints reads: base alone (static, or frozen consistency), or base fused with changes up to a version."""
    return base if static or consistency in ("static", "frozen") else fuse(base, changes, key, upto=version)
