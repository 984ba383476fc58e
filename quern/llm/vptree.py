"""Nearest neighbours by vantage-point trees, one per shard of the vectors.

A shard's tree splits its vectors by their distance to a vantage point, again and again, down to leaves. By the
triangle inequality each split bounds from below how near a leaf can come to a query, and the stored distances of every vector to the
upper vantage points bound how near that vector can. A query visits the leaves of least
bound first, and then those others whose bound * factor does not exceed the distance of its k-th neighbour so far; within a leaf it passes over the vectors whose
bound * factor does: factor 1 gives exact results, a larger one considers fewer vectors.

Shards are cells of space: an upper vantage-point tree, fitted on a bounded sample, assigns every vector to its cell, and a cell with
many vectors is several shards. A query first searches the cell that it lies in. The distance of its k-th neighbour there
then rules out other cells by their bound, and in those that remain it is the limit from the start, so that a shard
returns only what is nearer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.common import saved, table

#: Vectors of a shard and queries of a block (both on average: rows are dealt out by a hash), vectors of a leaf.
SHARD, BLOCK, LEAF = 8192, 16_384, 64
#: Queries that are searched at once.
STEP = 1024
#: How far the triangle inequality is relaxed; 1 is exact.
FACTOR = 3.5
#: Levels of a shard's tree whose vantage points have a stored distance to every vector.
UPPER = 5
#: Cells at most, and vectors of the sample for each cell, which bounds what the driver fits and broadcasts.
CELLS, SAMPLE = 64, 64
#: Bounds are lowered by this share of the lengths involved, as distances to vantage points are rounded.
SLIP = 1e-7
#: The same for stored distances, which are single precision; leaves that a query visits in the order of their bound before all others.
ROUND, NEAREST = 1e-6, 2


class Tree:
    """A vantage-point tree over the rows of x (float64)."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF, seed: int = 7):
        self.x = x
        rng = np.random.default_rng(seed)
        self.vantage: list[int] = []
        self.nodes: list[tuple] = []  # (vantage number, (side, lowest, highest, child), ...); child below 0: leaf ~child
        self.leaves: list[np.ndarray] = []
        self.upper: list[int] = []  # numbers of the vantage points of the upper levels
        self.root = self._build(np.arange(len(x)), leaf, rng, 0)
        self.square = (x**2).sum(axis=1)
        self.far = np.stack([np.sqrt(((x - x[self.vantage[n]]) ** 2).sum(axis=1)) for n in self.upper]).astype(np.float32) if self.upper else np.zeros((0, len(x)), np.float32)
        self.seen = 0  # pairs of a query and a vector of a leaf that no bound ruled out

    def _build(self, rows: np.ndarray, leaf: int, rng: np.random.Generator, depth: int) -> int:
        if len(rows) > leaf:
            v = int(rows[rng.integers(len(rows))])
            d = np.sqrt(((self.x[rows] - self.x[v]) ** 2).sum(axis=1))
            order = np.argsort(d, kind="stable")
            half = len(rows) // 2
            if d[order[0]] < d[order[-1]]:
                number, at = len(self.vantage), len(self.nodes)
                self.vantage.append(v)
                if depth < UPPER:
                    self.upper.append(number)
                self.nodes.append(())
                sides = [(float(d[part].min()), float(d[part].max()), self._build(rows[part], leaf, rng, depth + 1)) for part in (order[:half], order[half:])]
                self.nodes[at] = (number, sides)
                return at
        # vectors that all lie as far from a point are kept in leaves of the usual size
        first = len(self.leaves)
        parts = [rows[i : i + leaf] for i in range(0, len(rows), leaf)]
        if len(parts) > 1:
            self.nodes.append((None, [(0.0, np.inf, ~(first + i)) for i in range(len(parts))]))
            self.leaves += parts
            return len(self.nodes) - 1
        self.leaves.append(rows)
        return ~first

    def distances(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distance of each query to each vantage point, by how much it may be wrong)."""
        v = self.x[self.vantage]
        square = (q**2).sum(axis=1)[:, None] + (v**2).sum(axis=1)[None, :]
        return np.sqrt(np.maximum(square - 2 * q @ v.T, 0)), SLIP * np.sqrt(square)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """For each query and leaf, a lower bound of the distance to any vector there."""
        out = np.zeros((len(q), len(self.leaves)))
        d, slip = self.distances(q)
        todo = [(self.root, np.zeros(len(q)))]
        while todo:
            at, low = todo.pop()
            if at < 0:
                out[:, ~at] = low
                continue
            number, sides = self.nodes[at]
            for near, far, child in sides:
                more = low if number is None else np.maximum(low, np.maximum(near - d[:, number], d[:, number] - far) - slip[:, number])
                todo.append((child, more))
        return out

    def search(self, q: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, factor: float, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(distances, ids) of the k nearest rows of each query but those of its own id; absent ones are (inf, -1).

        With limit, rows farther than a query's limit need not be found.
        """
        n = len(q)
        best, who = np.full((n, k), np.inf), np.full((n, k), -1, np.int64)
        limit = np.full(n, np.inf) if limit is None else limit
        low = self.bounds(q)
        d, slip = self.distances(q)
        upper, slack = d[:, self.upper].T.astype(np.float32), slip[:, self.upper].max(axis=1, initial=0) + ROUND * d[:, self.upper].max(axis=1, initial=0)
        square = (q**2).sum(axis=1)

        def visit(leaf: int, here: np.ndarray) -> None:
            rows = self.leaves[leaf]
            most = np.minimum(best[here, -1], limit[here])
            bound = np.zeros((len(here), len(rows)), np.float32)
            for u, far in zip(upper, self.far, strict=True):
                np.maximum(bound, np.abs(u[here, None] - far[rows]), out=bound)
            near = ((bound - slack[here, None]) * factor <= most[:, None]) & (own[here, None] != ids[None, rows])
            self.seen += int(near.sum())
            # those that may be among the nearest, by one product of matrices, are then measured exactly
            about = square[here, None] + self.square[rows] - 2 * q[here] @ self.x[rows].T
            near &= about <= most[:, None] ** 2 + SLIP * (square[here, None] + self.square[rows])
            some = np.flatnonzero(near.any(axis=1))
            if not len(some):
                return
            near, here = near[some], here[some]
            i, j = np.nonzero(near)
            found = np.full(near.shape, np.inf)
            found[i, j] = np.sqrt(((q[here[i]] - self.x[rows[j]]) ** 2).sum(axis=1))
            both = np.concatenate([best[here], found], axis=1)
            names = np.concatenate([who[here], np.broadcast_to(ids[rows], found.shape)], axis=1)
            first = np.lexsort((names, both), axis=1)[:, :k]
            best[here], who[here] = np.take_along_axis(both, first, 1), np.take_along_axis(names, first, 1)

        # each query's own leaves first, for a near limit; then leaf by leaf all queries that still must look there
        order = np.argsort(low, axis=1, kind="stable")[:, :NEAREST]
        for turn in range(order.shape[1]):
            by = np.argsort(order[:, turn], kind="stable")
            for group in np.split(by, np.flatnonzero(np.diff(order[by, turn])) + 1):
                visit(int(order[group[0], turn]), group)
        done = np.zeros(low.shape, bool)
        np.put_along_axis(done, order, True, 1)
        for leaf in np.argsort(low.mean(axis=0), kind="stable").tolist():
            here = np.flatnonzero(~done[:, leaf] & (low[:, leaf] * factor <= np.minimum(best[:, -1], limit)))
            if len(here):
                visit(leaf, here)
        who[np.isinf(best)] = -1
        return best, who


class Cells:
    """The upper tree: cells of nearly equal shares of the sample x (float64), at most `most` of them."""

    def __init__(self, x: np.ndarray, most: int, seed: int = 11):
        self.vantage: list[np.ndarray] = []
        self.nodes: list[tuple[float, int, int]] = []  # (radius, child within, child beyond); child below 0: cell ~child
        self.n = 0
        self.root = self._build(x, most, np.random.default_rng(seed))

    def _build(self, x: np.ndarray, most: int, rng: np.random.Generator) -> int:
        if most > 1 and len(x) > 1:
            v = x[rng.integers(len(x))]
            d = np.sqrt(((x - v) ** 2).sum(axis=1))
            radius = float(np.quantile(d, (most // 2) / most, method="lower"))
            if d.min() <= radius < d.max():
                at = len(self.nodes)
                self.vantage.append(v)
                self.nodes.append(())
                self.nodes[at] = (radius, self._build(x[d <= radius], most // 2, rng), self._build(x[d > radius], most - most // 2, rng))
                return at
        self.n += 1
        return ~(self.n - 1)

    def look(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the cell of each vector, for each vector and cell a lower bound of the distance to any vector there)."""
        home, out = np.zeros(len(q), np.int64), np.zeros((len(q), self.n))
        todo = [(self.root, np.zeros(len(q)), np.ones(len(q), bool))]
        while todo:
            at, low, mine = todo.pop()
            if at < 0:
                out[:, ~at] = low
                home[mine] = ~at
                continue
            radius, near, far = self.nodes[at]
            v = self.vantage[at]
            d = np.sqrt(((q - v) ** 2).sum(axis=1))
            slip = SLIP * (np.sqrt((q**2).sum(axis=1)) + np.sqrt((v**2).sum()))
            todo.append((near, np.maximum(low, d - radius - slip), mine & (d <= radius)))
            todo.append((far, np.maximum(low, radius - d - slip), mine & (d > radius)))
        return home, out


def usable(v: Column) -> Column:
    """No null, no null or non-finite component, not all zero."""
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~odd & F.exists(v, lambda x: x != 0)


def _rows_of(v: pa.Array) -> np.ndarray:
    v = pa.concat_arrays(v.chunks) if isinstance(v, pa.ChunkedArray) else v
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)


def _fitted(p: DataFrame, n: int, shard: int) -> dict[int, Cells]:
    """The upper tree of each number of components, fitted on about SAMPLE vectors for each cell, chosen by a hash; none where one shard holds all."""
    cells = min(CELLS, -(-n // shard))
    if cells < 2:
        return {}
    lot = F.pmod(F.xxhash64(F.lit("cells"), "vec_id", "v"), F.lit(1 << 30)) / float(1 << 30)
    rows = p.filter(lot < SAMPLE * cells / n).select("vec_id", "v").dropDuplicates()
    found: dict[int, list] = {}
    for r in sorted(rows.collect(), key=lambda r: (r["vec_id"], r["v"])):
        found.setdefault(len(r["v"]), []).append(r["v"])
    total = sum(map(len, found.values()))
    return {dim: Cells(np.array(x, np.float64), max(1, round(cells * len(x) / total))) for dim, x in found.items()}


def _placed(df: DataFrame, trees: dict[int, Cells], bounds: bool) -> DataFrame:
    """df (vec_id, v, dim) with cell and, if asked for, bounds, the lower bound of each cell; one cell where there is no tree."""
    shared = df.sparkSession.sparkContext.broadcast(trees)  # CELLS vectors at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                tree = shared.value.get(dim)
                home, low = tree.look(_rows_of(part.column(1))) if tree else (np.zeros(len(part), np.int64), np.zeros((len(part), 1)))
                columns = [*part.columns, pa.array(home)] + [pa.array(low.tolist(), pa.list_(pa.float64()))] * bounds
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "v", "dim", "cell"] + ["bounds"] * bounds)

    kind = df.schema["v"].dataType.simpleString()
    return df.select("vec_id", "v", "dim").mapInArrow(run, f"vec_id long, v {kind}, dim int, cell long" + ", bounds array<double>" * bounds)


def _first(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(points: DataFrame, queries: DataFrame, k: int = 10, factor: float = FACTOR, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest points of each query, by Euclidean distance in double precision.

    Both take (vec_id long, embedding array of numbers). A query's candidates are the points of its own number of
    components and another vec_id; fewer than k give fewer rows, ties go to the smaller vec_id. Rows with a null
    vec_id and unusable vectors take no part. Queries that share a vec_id are one (with the smallest vector); points
    that do, repeated rows included, are each a candidate. Other columns, whatever their names, are not carried; an empty table on either side gives no rows.
    """

    def ready(df: DataFrame) -> DataFrame:
        kind = df.schema["embedding"].dataType.simpleString()
        v = F.col("embedding") if kind in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
        return df.select(F.col("vec_id").cast("long"), v.alias("v")).filter(F.col("vec_id").isNotNull() & usable(F.col("v"))).withColumn("dim", F.size("v"))

    p, q = ready(points), ready(queries).groupBy("vec_id").agg(F.min("v").alias("v"), F.min_by("dim", "v").alias("dim"))
    trees = _fitted(p, p.count(), shard)
    # rows equal in id and vector are dealt apart where they are read by several tasks
    p = saved(_placed(p, trees, False).withColumn("lot", F.xxhash64("vec_id", "v", F.spark_partition_id())), "points")
    q = saved(_placed(q, trees, True), "queries")
    cells = saved(p.groupBy("dim", "cell").agg(F.ceil(F.count("*") / shard).alias("shards")), "cells")  # CELLS rows for each number of components
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:

            def arrays(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                ids, x = t["vec_id"].to_numpy(), _rows_of(t["v"])
                order = np.lexsort((*x.T[::-1], ids))
                return ids[order], np.ascontiguousarray(x[order]), order

            (ids, x, _), (own, asked, order) = arrays(left), arrays(right)
            limit = right["limit"].to_numpy()[order]
            tree = Tree(x)
            for i in range(0, len(own), STEP):
                d, who = tree.search(asked[i : i + STEP], own[i : i + STEP], ids, k, factor, limit[i : i + STEP])
                some = np.isfinite(d) & (d <= limit[i : i + STEP, None])
                found["query_id"].append(np.repeat(own[i : i + STEP], some.sum(axis=1)))
                found["vec_id"].append(who[some])
                found["score"].append(d[some])
        flat = {n: np.concatenate(v) if v else np.zeros(0, np.float64 if n == "score" else np.int64) for n, v in found.items()}
        return pa.table(flat)

    def visit(asked: DataFrame) -> DataFrame:
        """What the queries (vec_id, v, dim, cell, limit) find in those cells; each of a cell's shards meets each block of its queries."""
        deal = asked.groupBy("dim", "cell").agg(F.ceil(F.count("*") / block).alias("blocks")).join(cells, ["dim", "cell"])
        left = p.join(deal, ["dim", "cell"]).withColumn("shard", F.pmod("lot", "shards")).withColumn("block", every(F.col("blocks")))
        right = asked.join(deal, ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64(F.lit(2), "vec_id"), "blocks")).withColumn("shard", every(F.col("shards")))
        key = ["dim", "cell", "shard", "block"]
        left, right = left.select(*key, "vec_id", "v"), right.select(*key, "vec_id", "v", "limit")
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, "query_id long, vec_id long, score double")

    home = saved(_first(visit(q.withColumn("limit", F.lit(float("inf")))), k), "home")
    if not trees:
        return home
    limit = home.groupBy("query_id").agg(F.when(F.count("*") == k, F.max("score")).alias("limit"))
    rest = q.join(limit, q["vec_id"] == limit["query_id"], "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf"))))
    others = F.transform("bounds", lambda b, i: F.struct(i.cast("long").alias("at"), b.alias("low")))
    others = F.filter(others, lambda c: (c["at"] != F.col("cell")) & (c["low"] * factor <= F.col("limit")))
    rest = rest.select("vec_id", "v", "dim", "limit", F.explode(others).alias("other")).select("vec_id", "v", "dim", F.col("other.at").alias("cell"), "limit")
    return _first(home.drop("rank").unionByName(visit(rest)), k)


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.filter("vec_id % 100 = 0"))
