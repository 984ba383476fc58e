"""Tables with a base version and increments in a folder, and commits that are one rename.

The folder holds numbered manifests; the highest is the current state. A commit writes the changed tables' files first and then its
manifest, under a name of its own, and renames that to the next number: readers see all of a commit or nothing, and of
two writers that start from the same state the second one fails. Statements add increments, which reads fuse with
the base; freeze() merges them into a new base and drops expired rows.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators import merge
from quern.operators.prejoin import prejoin
from quern.sources.catalog import Table, write_base


class ConcurrentChange(RuntimeError):
    """Another writer committed since this one began."""


def _table(spec: dict) -> Table:
    return Table(**{**spec, "columns": tuple(map(tuple, spec["columns"])), "key": tuple(spec["key"])})


class Store:
    """A folder on storage that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._path = path
        self._fs = path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def state(self) -> dict:
        """The current manifest: its version, and for each table its declaration, files, and the stored name of each column."""
        top = self._path(f"{self.root}/manifest")
        names = [f.getPath().getName() for f in self._fs.listStatus(top)] if self._fs.exists(top) else []
        done = max((n for n in names if n.isdigit()), default=None)
        if done is None:
            return {"version": 0, "tables": {}, "users": {}}
        return json.loads(self.spark.read.text(f"{self.root}/manifest/{done}", wholetext=True).first()[0])

    def commit(self, state: dict, changes: list[tuple[str, DataFrame]] = ()) -> dict:
        """Make state, with these change rows of its tables, the version after its own."""
        version = state["version"] + 1
        tables = {n: dict(t) for n, t in state["tables"].items()}
        for name, rows in changes:
            path = f"{self.root}/{name}/increment-{uuid.uuid4().hex}"
            rows.write.parquet(path)
            tables[name]["increments"] = [*tables[name]["increments"], [version, path]]
        new = {**state, "version": version, "tables": tables}
        draft, final = self._path(f"{self.root}/manifest/draft-{uuid.uuid4().hex}"), self._path(f"{self.root}/manifest/{version:012d}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise ConcurrentChange(f"version {version} is another writer's")
        return new

    def put(self, state: dict, changes: list[tuple[str, DataFrame]], locked: list[tuple[str, DataFrame]] = ()) -> dict:
        """As commit, also where others committed since state, if they changed no row that is changed or locked here.

        locked: by table, rows with the key's columns that must be as they were.
        """
        while True:
            try:
                return self.commit(state, changes)
            except ConcurrentChange:
                state = self._rebased(state, [*changes, *locked])

    def _rebased(self, state: dict, held: list[tuple[str, DataFrame]]) -> dict:
        now = self.state()
        for name, rows in held:
            old, new = state["tables"].get(name), now["tables"].get(name)
            if new is None or any(new[k] != old[k] for k in ("table", "stored", "base")):
                raise ConcurrentChange(f"{name} was declared anew or merged meanwhile")
            keys = [new["stored"][k] for k in self.table(now, name).key]
            seen = [p for _, p in old["increments"]]
            more = [p for _, p in new["increments"] if p not in seen]
            if more:
                schema = T.StructType([f for f in self._schema(new).fields if f.name in keys])
                theirs = self.spark.read.schema(schema).parquet(*more).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
                same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
                if not rows.select(*keys).join(theirs, same, "left_semi").isEmpty():
                    raise ConcurrentChange(f"rows of {name} were changed meanwhile")
        return now

    def table(self, state: dict, name: str) -> Table:
        if name not in state["tables"]:
            raise ValueError(f"table {name} does not exist")
        return _table(state["tables"][name]["table"])

    @staticmethod
    def entry(table: Table) -> dict:
        return {"table": asdict(table), "stored": {n: n for n, _ in table.columns}, "used": [n for n, _ in table.columns], "base": None, "base_version": 0, "increments": []}

    def _schema(self, entry: dict) -> T.StructType:
        kinds = {f.name: f.dataType for f in _table(entry["table"]).schema}
        return T.StructType([T.StructField(stored, kinds[n]) for n, stored in entry["stored"].items()])

    def changes(self, entry: dict, pending: list[DataFrame] = ()) -> DataFrame:
        """All increments of a table, and rows that are not committed yet."""
        schema = self._schema(entry)
        meta = T._parse_datatype_string("_version long, _seq long, _op string, _set array<string>")
        paths = [p for _, p in entry["increments"]]
        whole = T.StructType([*schema.fields, *meta.fields])
        rows = self.spark.read.schema(whole).parquet(*paths) if paths else self.spark.createDataFrame([], whole)
        for p in pending:
            rows = rows.unionByName(p.select(*[c for c in whole.names if c in p.columns]), allowMissingColumns=True)
        return rows

    def read(self, state: dict, name: str, *, static: bool = False, pending: list[DataFrame] = (), upto: int | None = None, lookups: bool = True) -> DataFrame:
        """One scan of a table: its base, fused with increments unless static, with the columns that its lookup fills, in its declared order."""
        entry, table = state["tables"][name], self.table(state, name)
        schema = self._schema(entry)
        base = self.spark.read.schema(schema).parquet(entry["base"]) if entry["base"] else self.spark.createDataFrame([], schema)
        if not static and (entry["increments"] or pending):
            base = merge.fuse(base, self.changes(entry, pending), [entry["stored"][k] for k in table.key], upto=upto)
        rows = base.select(*[F.col(stored).alias(n) for n, stored in entry["stored"].items()])
        if lookups and table.lookup and table.lookup.table in state["tables"]:
            other = self.table(state, table.lookup.table)
            rows = prejoin(rows, self.read(state, other.name, static=static, lookups=False), table.lookup, list(other.key))
        return rows.select(*[n for n, _ in table.columns])

    def freeze(self, name: str | None = None) -> dict:
        """Merge the increments of a table (or of all) into new base versions, dropping expired rows."""
        state = self.state()
        tables = dict(state["tables"])
        for n in [name] if name else list(tables):
            table = self.table(state, n)
            rows = merge.expire(self.read(state, n, lookups=False), table.expire_info)
            path = f"{self.root}/{n}/base-{uuid.uuid4().hex}"
            stored = tables[n]["stored"]
            write_base(rows.select(*[F.col(c).alias(s) for c, s in stored.items()]), path, [stored[k] for k in table.key], codec=table.codec, bloom=bool(table.options.get("use_bloom_filter")))
            tables[n] = {**tables[n], "base": path, "base_version": state["version"] + 1, "increments": []}
        return self.commit({**state, "tables": tables})
