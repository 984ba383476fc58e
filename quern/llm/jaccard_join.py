"""N-gram Jaccard self-join of documents with Bayesian pruning of candidates.

A document is the set of its five-word shingles. Documents with equal sets are one class. Classes that share a
band of MinHash values are candidates, and so is whatever they are connected with through others. Candidate pairs
are compared on their MinHash values a few at a time: given the matches so far, the posterior probability (under a uniform prior) that
the similarity reaches the threshold is a tail of a binomial distribution, and a pair is dropped as soon as it falls below
the tolerance. The pairs that survive are verified on the sets themselves.

Pairs never become rows. Connected classes meet in one group, or, where these are many, block against block; where there would be more
blocks than bands, only the classes that share a band meet, and a pair is compared in the first band that it shares. A group
compares its pairs in arrays and gives each class's number of links and one link to its component.

With exact=True candidates share a shingle of their prefixes instead of a band: of the sets in one order, the first n - ceil(t n) + 1 shingles, one
of which any two sets of similarity t have in common; nothing is pruned then.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import BASES, Rolling, WordHasher, drop_saved, mix64, saved, slices, table, text_bytes
from quern.llm.components import components

WORDS, THRESHOLD = 5, 0.8
#: MinHash bands and values in a band: two documents of similarity 0.8 share none with probability 1.5e-5.
BANDS, ROWS = 28, 5
#: Values compared between two looks at the posterior, and the probability below which a pair is dropped.
STEP, TOLERANCE = 20, 1e-6
#: Classes of a component from which it is split into blocks, classes of a block, and classes of a group of small components;
#: and the shingles that stand for a class where the sets are long, so that no group outgrows its task.
LARGE, BLOCK, GROUP = 1000, 500, 500
#: Blocks of a component from which only classes that share a band meet.
MOST_BLOCKS = BANDS
SHINGLES = 1000

_RNG = np.random.default_rng(20)
_MASK, _FACTOR = _RNG.integers(0, 2**64, BANDS * ROWS, np.uint64), _RNG.integers(0, 2**64, BANDS * ROWS, np.uint64) | np.uint64(1)


class Shingler:
    """Sets of shingle hashes and MinHash values of many texts at once."""

    def __init__(self, words: int = WORDS):
        self.n, self.hasher, self.roll = words, WordHasher(), Rolling(BASES[1])

    def sets(self, texts: pa.Array) -> list[np.ndarray]:
        """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle, one without words has none."""
        a, b, start = self.hasher(*text_bytes(texts))
        h = mix64(a + (b << np.uint64(1)))
        count = np.diff(start)
        n = np.where(count < self.n, (count > 0).astype(np.int64), count - self.n + 1)
        first = np.cumsum(n) - n
        at = np.repeat(start[:-1] - first, n) + np.arange(n.sum())
        size = np.repeat(np.minimum(count, self.n), n)
        s = mix64(self.roll.ranges(self.roll.prefix(h), at, at + size) + size.astype(np.uint64))
        return [np.unique(s[i : i + k]) for i, k in zip(first, n, strict=True)]


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """One row of 32-bit MinHash values for each set; the largest value throughout for an empty one."""
    out = np.full((len(sets), BANDS * ROWS), 2**32 - 1, np.uint32)
    some = [i for i, s in enumerate(sets) if len(s)]
    if some:
        s = np.concatenate([sets[i] for i in some])
        at = np.cumsum([0, *(len(sets[i]) for i in some[:-1])])
        for j in range(BANDS * ROWS):
            out[some, j] = np.minimum.reduceat(((s ^ _MASK[j]) * _FACTOR[j]) >> np.uint64(32), at)
    return out


def bands(values: np.ndarray) -> np.ndarray:
    h = np.zeros((len(values), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        h = mix64(h * np.uint64(BASES[0]) + values[:, r::ROWS].astype(np.uint64))
    return h


def prefixes(sets: list[np.ndarray], threshold: float = THRESHOLD) -> list[np.ndarray]:
    """Of each sorted set the first shingles, one of which it has in common with any set of that similarity."""
    t = Fraction(str(threshold))
    return [s[: len(s) - math.ceil(t * len(s)) + 1] if len(s) else s for s in sets]


def least_matches(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """The fewest matches among n values at which the similarity reaches the threshold with probability `tolerance` at least.

    With m matches of n the similarity has the Beta(m + 1, n - m + 1) posterior, whose upper tail at the threshold is that of
    at most m successes in n + 1 trials.
    """
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


class Verifier:
    """Links among the classes of one group; with a band, only those between classes that share no earlier one and this one."""

    def __init__(self, sets: list[np.ndarray], threshold: float = THRESHOLD, band: int = -1, prune: bool = True):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.values = minhashes(sets)
        self.share = Fraction(str(threshold))
        ids = np.unique(np.concatenate(sets), return_inverse=True)[1] if sets else np.zeros(0, np.int64)
        self.ids = np.split(ids, np.cumsum(self.sizes)[:-1])
        self.flag = np.zeros(int(ids.max(initial=-1)) + 1, bool)
        self.least = [(n, least_matches(n, threshold)) for n in range(STEP, BANDS * ROWS + 1, STEP)] if prune else []
        self.band, self.keys = band, bands(self.values) if band >= 0 else None

    def linked(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of others whose similarity to i reaches the threshold."""
        p, q = self.share.numerator, self.share.denominator
        a, b = self.sizes[i], self.sizes[others]
        others = others[(np.minimum(a, b) * q >= np.maximum(a, b) * p) & (b > 0)] if a else others[:0]
        if self.band >= 0 and len(others):
            shared = self.keys[others] == self.keys[i]
            others = others[shared[:, self.band] & (shared.argmax(axis=1) == self.band)]
        matches, done = np.zeros(len(others), np.int64), 0
        for n, least in self.least:
            if not len(others):
                return others
            matches += (self.values[others, done:n] == self.values[i, done:n]).sum(axis=1)
            keep = matches >= least
            others, matches, done = others[keep], matches[keep], n
        if not len(others):
            return others
        self.flag[self.ids[i]] = True
        both = np.add.reduceat(self.flag[np.concatenate([self.ids[j] for j in others])].astype(np.int64), np.cumsum(self.sizes[others]) - self.sizes[others])
        self.flag[self.ids[i]] = False
        return others[both * q >= (a + self.sizes[others] - both) * p]


def _links(nodes: np.ndarray, left: np.ndarray, right: np.ndarray | None, v: Verifier) -> tuple[np.ndarray, np.ndarray]:
    """(number of links, least node that is reached) of each; pairs within left, or between left and right if that is given."""
    count, root = np.zeros(len(nodes), np.int64), list(range(len(nodes)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for k, i in enumerate(left):
        found = v.linked(i, left[k + 1 :] if right is None else right)
        count[i] += len(found)
        count[found] += 1
        for j in found.tolist():
            a, b = top(int(i)), top(j)
            if a != b:
                a, b = (a, b) if nodes[a] < nodes[b] else (b, a)
                root[b] = a
    return count, np.array([nodes[top(i)] for i in range(len(nodes))], np.int64)


def _described(docs: DataFrame, words: int, threshold: float, exact: bool) -> DataFrame:
    """(doc_id, mark, n, k1, k2, bands): a 128-bit key of each document's set, and its MinHash bands, or its prefix if exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for part in slices(batch, 2, 1 << 20):
                sets = shingler.sets(part.column(2))
                keys = [x.view(np.int64) for x in (prefixes(sets, threshold) if exact else bands(minhashes(sets)))]
                k1 = np.array([mix64(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                k2 = np.array([mix64(s ^ np.uint64(BASES[0])).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate(keys)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(k1), pa.array(k2), flat], names=["doc_id", "mark", "n", "k1", "k2", "bands"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(_text()).alias("mark"), _text().alias("text"))
    return rows.mapInArrow(run, "doc_id long, mark long, n long, k1 long, k2 long, bands array<long>")


def _text():
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _meetings(wanted: DataFrame, hits: DataFrame, exact: bool) -> DataFrame:
    """wanted (node, doc_id, mark, comp, size) with keys: the groups (g, i, j, b) that each class is in and its own block there.

    size is the component's number of classes, or of SHINGLES shingles if that is more. Small components share groups by a hash (i is -1); a large one
    has a group for every two of its blocks, and each with itself. A component of more than MOST_BLOCKS blocks has such groups for each of its bands b instead,
    of those classes that share it.
    """
    groups = max(1, -(-wanted.count() // GROUP))

    def blocks(size: Column, g: Column, b: Column) -> Column:
        n = F.ceil(size / BLOCK)
        own = F.pmod(F.xxhash64("node"), n)
        return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda j: F.struct(g.alias("g"), F.least(own, j).alias("i"), F.greatest(own, j).alias("j"), b.alias("b"), own.alias("own")))

    none = F.lit(-1).cast("long")
    alone = F.array(F.struct(F.pmod(F.xxhash64("comp"), F.lit(groups)).alias("g"), none.alias("i"), none.alias("j"), none.alias("b"), F.lit(0).cast("long").alias("own")))
    every = F.when(F.col("size") > LARGE, blocks(F.col("size"), F.col("comp"), none)).otherwise(alone)
    if exact:
        return wanted.withColumn("keys", every)
    wide = F.col("size") > MOST_BLOCKS * BLOCK
    big = wanted.filter(wide).select("node", "n").join(hits, "node")
    sizes = big.groupBy("band").agg(F.count("*").alias("c"), F.greatest(F.count("*"), F.ceil(F.sum("n") / SHINGLES)).alias("s")).filter("c > 1")
    shared = big.join(sizes, "band").select("node", F.explode(blocks(F.col("s"), F.col("band"), F.col("b"))).alias("key"))
    shared = shared.groupBy("node").agg(F.collect_list("key").alias("shared"))
    out = wanted.join(shared, "node", "left")
    return out.withColumn("keys", F.when(wide, F.coalesce("shared", F.array().cast("array<struct<g:bigint,i:bigint,j:bigint,b:bigint,own:bigint>>"))).otherwise(every)).drop("shared")


def _verified(docs: DataFrame, wanted: DataFrame, words: int, threshold: float, exact: bool) -> DataFrame:
    """(node, links, root, large): of each class in wanted (node, doc_id, mark, comp, keys), by the groups it is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for part in slices(batch, 3, 1 << 20):
                blobs = pa.array([s.tobytes() for s in shingler.sets(part.column(3))], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], blobs], names=["node", "comp", "keys", "set"])

    key = "struct<g:bigint,i:bigint,j:bigint,b:bigint,own:bigint>"
    rows = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64(_text()).alias("m"), _text().alias("text"))
    # hashed by partition: ids of classes that have a candidate, a small part of the texts that they meet, which then need no sort
    rows = rows.join(wanted.hint("shuffle_hash"), F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("m") == F.col("mark")))
    rows = rows.select("node", "comp", "keys", "text").mapInArrow(run, f"node long, comp long, keys array<{key}>, set binary")
    rows = rows.select(F.explode("keys").alias("key"), "node", "comp", "set").select("key.*", "node", "comp", "set")

    def check(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        _, i, j, band = (k.as_py() for k in key)
        nodes, comp, own = (t[c].to_numpy() for c in ("node", "comp", "own"))
        comp = comp if i < 0 else np.zeros(len(nodes), np.int64)
        order = np.lexsort((nodes, comp))
        order = order[np.concatenate([[True], nodes[order][1:] != nodes[order][:-1]])]  # rows equal in id and text come twice
        nodes, comp, own = nodes[order], comp[order], own[order]
        sets = [np.frombuffer(b, np.uint64) for b in t["set"].take(pa.array(order)).to_pylist()]
        count, root = np.zeros(len(nodes), np.int64), nodes.copy()
        cuts = [0, *(np.flatnonzero(np.diff(comp)) + 1).tolist(), len(nodes)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            every = np.arange(b - a)
            left, right = (every, None) if i == j else (every[own[a:b] == i], every[own[a:b] == j])
            count[a:b], root[a:b] = _links(nodes[a:b], left, right, Verifier(sets[a:b], threshold, band, not exact))
        return pa.table({"node": nodes, "links": count, "root": root, "large": pa.array([i >= 0] * len(nodes), pa.bool_())})

    return rows.groupBy("g", "i", "j", "b").applyInArrow(check, "node long, links long, root long, large boolean")


def similar(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, exact: bool = False) -> DataFrame:
    """(doc_id, mark, class_id, first_mark, copies, links) of each document: its near-duplicate class and its links.

    Two documents are linked where the Jaccard similarity of their sets of `words`-word shingles is `threshold` or more;
    classes are the connected components. class_id is the least doc_id of the class, first_mark the hash of that
    document's text. copies counts the documents of the same set of shingles, this one included; links the other sets that are
    linked with it. A text of fewer words is one shingle; one without words (or null) is no one's copy and a class of its own.
    Rows equal in doc_id and text each count as a copy. A null doc_id is the least. Other columns, whatever their names, are not carried; an empty table gives no rows. A very long
    text is one set of shingles, of which a group holds as many as SHINGLES for each of its classes. With exact, no link is lost; without, one of similarity 0.8
    is with probability 1.5e-5 (no band is shared) and 1e-6 (pruned).
    """
    rows = saved(_described(docs, words, threshold, exact), "sets")
    some = rows.filter("n > 0")
    each = some.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "mark")).alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.max("n").alias("n"))
    classes = saved(each.withColumn("node", F.monotonically_increasing_id()), "classes")

    hits = classes.select("node", F.posexplode("bands").alias("b", "band")).withColumn("b", F.col("b").cast("long"))
    centres = hits.groupBy("band").agg(F.min("node").alias("v"), F.count("*").alias("c")).filter("c > 1").drop("c")
    edges = hits.join(centres, "band").filter("node <> v").select(F.col("node").alias("u"), "v")
    candidates = components(edges)
    comp = candidates.join(classes.select("node", "rep.*", "n"), "node")
    sizes = comp.groupBy("root").agg(F.greatest(F.count("*"), F.ceil(F.sum("n") / SHINGLES)).alias("size"))
    placed = saved(comp.join(sizes, "root").select("node", "doc_id", "mark", "n", F.col("root").alias("comp"), "size"), "placed")
    drop_saved(candidates)
    wanted = saved(_meetings(placed, hits, exact), "wanted")
    drop_saved(placed)

    found = saved(_verified(docs, wanted, words, threshold, exact), "links")
    drop_saved(wanted)
    links = found.groupBy("node").agg(F.sum("links").alias("links"), F.min(F.when(~F.col("large"), F.col("root"))).alias("root"))
    whole = components(found.filter("large AND node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))).select("node", F.col("root").alias("joined"))
    nodes = classes.select("node", "k1", "k2", "rep", "copies").join(links, "node", "left").join(whole, "node", "left")
    nodes = nodes.withColumn("root", F.coalesce("joined", "root", "node")).drop("joined")
    first = nodes.groupBy("root").agg(F.min("rep").alias("first"))
    nodes = nodes.join(first, "root").select("k1", "k2", "copies", F.coalesce("links", F.lit(0).cast("long")).alias("links"), "first")
    out = rows.drop("bands").join(nodes, (rows["n"] > 0) & (rows["k1"] == nodes["k1"]) & (rows["k2"] == nodes["k2"]), "left")
    alone = F.col("first").isNull()
    return out.select(
        rows["doc_id"], rows["mark"],
        F.when(alone, rows["doc_id"]).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.when(alone, rows["mark"]).otherwise(F.col("first.mark")).alias("first_mark"),
        F.coalesce("copies", F.lit(1).cast("long")).alias("copies"), F.coalesce("links", F.lit(0).cast("long")).alias("links"),
    )


def one_of_each(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the near-duplicates: of each class the document with the least doc_id stays, rows equal to it included once."""
    stay = similar(docs, words, threshold).filter(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("mark") == F.col("first_mark")))
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null")).alias("_quern_key")  # noqa: E731  a null id is a key too
    stay = stay.select(key("doc_id"), F.col("mark").alias("_quern_mark")).distinct()
    both = docs.select("*", key("doc_id"), F.xxhash64(_text()).alias("_quern_mark")).join(stay.hint("shuffle_hash"), ["_quern_key", "_quern_mark"], "left_semi")
    return both.dropDuplicates(["_quern_key", "_quern_mark"]).select(*docs.columns)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "copies", "links")
