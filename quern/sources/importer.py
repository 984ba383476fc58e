"""Bulk import: configured jobs that bring delimited files into a store as one increment a table.

A job file has a section for each table:

    [orders]
    data = hdfs://host/dir/orders.txt
    columns = o_orderkey, o_totalprice, -, o_comment
    delimiter = |
    record_delimiter = \\n
    null = \\N
    nop = -
    title = true
    bad = hdfs://host/dir/orders.bad
    delete = false

Lines that don't have the table's fields, or whose fields don't have its types, go to `bad` and not into the table.
"""

from __future__ import annotations

import configparser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.catalog import NOP_MASK, rejected, read_delimited
from quern.sources.store import Store


def jobs(text: str) -> dict[str, dict[str, str]]:
    """The sections of a job file."""
    parser = configparser.ConfigParser(interpolation=None)
    parser.read_string(text)
    return {name: dict(parser[name]) for name in parser.sections()}


def _sign(text: str) -> str:
    return text.encode().decode("unicode_escape")


def load_files(store: Store, text: str) -> dict[str, tuple[int, int]]:
    """Run all jobs of a file as one commit; (rows brought in, lines refused) by table."""
    state = store.state()
    changes, counts = [], {}
    for name, job in jobs(text).items():
        table, entry = store.table(state, name), state["tables"][name]
        columns = [None if c.strip() == "-" else c.strip() for c in job["columns"].split(",")] if "columns" in job else None
        rows = read_delimited(
            store.spark, job["data"], table, sep=_sign(job.get("delimiter", r"\x01")), line=_sign(job.get("record_delimiter", r"\n")), null=job.get("null", "\\N"), nop=job.get("nop"),
            columns=columns, title=job.get("title", "false") == "true", keep_bad=True,
        )
        good, bad = rows.filter("_bad IS NULL").drop("_bad"), rejected(rows)
        if "bad" in job:
            bad.write.mode("overwrite").text(job["bad"])
        changes.append((name, _increment(good, entry, list(table.key), job.get("delete", "false") == "true", state["version"] + 1)))
        counts[name] = (good.count(), bad.count())
    store.commit(state, changes)
    return counts


def _increment(rows: DataFrame, entry: dict, key: list[str], delete: bool, version: int) -> DataFrame:
    """Change rows: each line sets the fields that it has, or deletes its key. Of lines of one key any may come last."""
    stored, names = entry["stored"], [c for c in rows.columns if c not in (*key, NOP_MASK)]
    given = F.col(NOP_MASK) if NOP_MASK in rows.columns else F.array(*[F.lit(n) for n in [*key, *names]])
    mask = F.array_compact(F.array(*[F.when(F.array_contains(given, n), F.lit(stored[n])) for n in names])).cast("array<string>")
    out = [F.col(k).alias(stored[k]) for k in key] + ([] if delete else [F.col(n).alias(stored[n]) for n in names])
    return rows.select(
        *out, F.lit(version).cast("long").alias("_version"), F.monotonically_increasing_id().alias("_seq"),
        F.lit("delete" if delete else "upsert").alias("_op"), (F.array().cast("array<string>") if delete else mask).alias("_set"),
    )
