"""A change log as a stream: ordered mutations from a directory, resumed from a checkpoint.

Files of a change directory hold rows (table, version, seq, op, key, and the changed values). A replay reads those that
are new, keeps chosen tables, tags each row with its partitions, and hands every batch to a sink. Delivery is at least
once per batch number; the sinks here write by batch number, so that a batch that is run again replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

#: Databases and tables that rows are dealt to, by the value of their partition key.
DATABASES, PER_TABLE = 16, 4096


def changes(spark: SparkSession, path: str, schema: T.StructType | str, *, files_per_batch: int = 64) -> DataFrame:
    """The change directory as a stream; each batch takes so many files at most."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def only_tables(log: DataFrame, tables: list[str], column: str = "table") -> DataFrame:
    return log.filter(F.col(column).isin(tables))


def partitioned(log: DataFrame, key: str, databases: int = DATABASES, tables: int = PER_TABLE) -> DataFrame:
    """With db_partition and table_partition: the key's value modulo the number of each."""
    return log.withColumns({"db_partition": F.pmod(F.col(key), F.lit(databases)).cast("int"), "table_partition": F.pmod(F.col(key), F.lit(tables)).cast("int")})


def sparse(log: DataFrame, values: list[str], mask: str = "_set") -> DataFrame:
    """One map of the changed columns for each mutation, NULL values included; an absent name is unchanged."""
    return log.withColumn("changed", F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in values]), lambda e: F.array_contains(mask, e["name"])))).drop(*values)


def dense(log: DataFrame, base: DataFrame, key: list[str], values: list[str], mask: str = "_set") -> DataFrame:
    """Whole rows: what a mutation leaves unchanged is looked up in base (a stream-static join by key)."""
    side = base.select(*key, *[F.col(c).alias(f"_b_{c}") for c in values])
    both = log.join(side, key, "left")
    return both.withColumns({c: F.when(F.array_contains(mask, c), F.col(c)).otherwise(F.col(f"_b_{c}")) for c in values}).drop(*[f"_b_{c}" for c in values])


def replay(log: DataFrame, checkpoint: str, each_batch: Callable[[DataFrame, int], None], *, wait: bool = True) -> StreamingQuery:
    """Hand all that is new since the checkpoint to each_batch(rows, number), then stop; a later call goes on from there."""
    query = log.writeStream.foreachBatch(each_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if wait:
        query.awaitTermination()
    return query


def to_partitions(path: str, by: str = "db_partition") -> Callable[[DataFrame, int], None]:
    """A sink with one folder for each batch and partition, its rows in order."""

    def write(rows: DataFrame, number: int) -> None:
        rows.repartition(by).sortWithinPartitions(by, "version", "seq").write.mode("overwrite").partitionBy(by).parquet(f"{path}/batch={number:012d}")

    return write


def routed(observers: dict[str, tuple[Callable[[DataFrame, int], None], list[str] | None]], threads: int = 4, by: str = "db_partition") -> Callable[[DataFrame, int], None]:
    """A sink that hands each batch to several observers, (sink, its tables or None for all), each once for every router thread.

    A thread's rows are those whose partition falls to it, in order. An observer that fails fails the batch, which is then run again for all of them.
    """

    def write(rows: DataFrame, number: int) -> None:
        rows.persist()
        try:
            with ThreadPoolExecutor(max_workers=threads) as pool:
                work = []
                for sink, tables in observers.values():
                    mine = rows if tables is None else only_tables(rows, tables)
                    for i in range(threads):
                        part = mine.filter(F.pmod(F.col(by), F.lit(threads)) == i)
                        work.append(pool.submit(sink, part, number * threads + i))
                for w in work:
                    w.result()
        finally:
            rows.unpersist()

    return write
