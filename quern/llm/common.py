"""Helpers shared by the training-data operators: table access, shared storage, byte-level word views."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators of words in every contract of this subpackage: space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, on one machine where that is unset, the warehouse."""
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/quern-tmp"


_MADE: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that saved() writes within are deleted at the end, but for those that are to be kept."""
    _MADE.append([])
    try:
        yield
    finally:
        for path in _MADE.pop():
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def saved(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Cut lineage: write df as Parquet into the shared folder and read it back; the folder goes with its scratch(), unless it is to be kept, or when the JVM ends.

    The written files outlive any executor, so a lost one costs no recomputation beyond this table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quern-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _MADE and not keep:
        _MADE[-1].append(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def drop_saved(df: DataFrame) -> None:
    """Delete a table that saved() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for top in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if top.rpartition("/")[2].startswith("quern-"):
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def sparse_rows(df: DataFrame, by: list[str]) -> tuple[pa.Table, list[tuple[np.ndarray, np.ndarray]]]:
    """A bounded sample's rows in order of `by`, and their features (int32 keys, float32 counts) as views of two blocks of memory."""
    t = df.toArrow()
    t = t.sort_by([(c, "ascending") for c in by]).combine_chunks()
    blocks = []
    for name, kind in (("keys", "<i4"), ("counts", "<f4")):
        column = t[name].combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
        data, off = text_bytes(column)
        blocks.append((data.tobytes(), off, kind))
    views = [[np.frombuffer(data, kind, (b - a) // 4, a) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)] for data, off, kind in blocks]
    return t.drop_columns(["keys", "counts"]), list(zip(*views, strict=True))


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 3 is 1; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def trainable(doc_id: Column) -> Column:
    """Rows that may teach a model: a known id outside the held-out fold."""
    return doc_id.isNotNull() & (F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1)


def slices(batch: pa.RecordBatch, column: int, most: int = 4 << 20):
    """Cut a batch into row ranges whose text is at most `most` bytes (one row at least)."""
    ends = text_offsets(batch.column(column))
    start, n = 0, batch.num_rows
    while start < n:
        end = max(start + 1, int(np.searchsorted(ends, ends[start] + most, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def text_offsets(texts: pa.Array) -> np.ndarray:
    """Byte offsets (n + 1) of a string array within its data buffer."""
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all texts in a row, offsets from 0); a null text has no bytes."""
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if texts.null_count:  # the slot of a null may span bytes
        texts = texts.fill_null("")
    off = text_offsets(texts)
    data = texts.buffers()[2]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the index of the first word of each text (n + 1 values)."""
    edge = np.zeros(len(data) + 1, bool)  # a word never crosses a text's end
    edge[off] = True
    word = ~_SPACE[data]
    before = np.zeros(len(data), bool)
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    filled = 1
    step = base & (2**64 - 1)
    while filled < n:  # doubling: out[f:2f] = out[:f] * base**f
        more = min(filled, n - filled)
        out[filled : filled + more] = out[:more] * np.uint64(step)
        step = step * step & (2**64 - 1)
        filled += more
    return out


BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


class Rolling:
    """Polynomial hashes (mod 2**64) of any ranges of a sequence, all in a few array passes.

    hash(s, e) = sum(x[i] * B**(e - 1 - i)); the powers of B and of its inverse are kept between calls.
    """

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        n = len(values) + 1
        if len(self.up) < n:
            self.up, self.down = _powers(self.base, n * 5 // 4), _powers(self.inverse, n * 5 // 4)
        out = np.zeros(n, np.uint64)
        np.cumsum(values * self.down[: n - 1], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return (prefix[e] - prefix[s]) * self.up[np.maximum(e - 1, 0)]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, roll: Rolling) -> np.ndarray:
    """A 64-bit hash of each word's bytes (and length)."""
    p = roll.prefix(data.astype(np.uint64) + np.uint64(1))
    return mix64(roll.ranges(p, starts, ends) + (ends - starts).astype(np.uint64))


class WordHasher:
    """Two independent 64-bit hashes of every word of many texts."""

    STEP = 1 << 20

    def __init__(self) -> None:
        self.rolls = [Rolling(b) for b in BASES]

    def __call__(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first hash, second hash, index of each text's first word); bytes are taken a megabyte at a time, cut behind a separator or a text's end."""
        places, hashes, at, n = [np.zeros(0, np.int64)], [np.zeros((2, 0), np.uint64)], 0, len(data)
        while at < n:
            end = min(at + self.STEP, n)
            if end < n:
                gap = np.flatnonzero(_SPACE[data[at:end]])
                cut = int(off[np.searchsorted(off, end, side="right") - 1])
                end = max(cut, at + int(gap[-1]) + 1 if len(gap) else 0)
                while end <= at:  # one word fills the step
                    more = np.flatnonzero(_SPACE[data[at + self.STEP : at + 16 * self.STEP]])
                    cut = int(off[np.searchsorted(off, at + self.STEP, side="left")])
                    end = min(cut, at + self.STEP + int(more[0]) + 1 if len(more) else cut)
            part = data[at:end]
            inner = off[np.searchsorted(off, at, side="left") : np.searchsorted(off, end, side="right")] - at
            starts, ends, _ = word_bounds(part, np.concatenate([[0], inner, [end - at]]))
            places.append(starts + at)
            hashes.append(np.stack([word_hashes(part, starts, ends, roll) for roll in self.rolls]))
            at = end
        one, two = np.concatenate(hashes, axis=1)
        return one, two, np.searchsorted(np.concatenate(places), off)


def sliding(values: np.ndarray, width: int, least: bool = True) -> np.ndarray:
    """The least (or largest) of each `width` neighbours; as many results as there are full windows."""
    pick = np.minimum if least else np.maximum
    if len(values) < width:
        return values[:0]
    done = 1
    while done * 2 <= width:
        values = pick(values[:-done], values[done:])
        done *= 2
    return values if done == width else pick(values[: len(values) - (width - done)], values[width - done :])


class Members:
    """Fast membership of many values in a set of unsigned 64-bit values: a bit table first, then a search."""

    BITS = 20

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.table = np.zeros(1 << self.BITS, bool)
        self.shift = np.uint64(64 - self.BITS)
        self.table[self.values >> self.shift] = True

    def where(self, x: np.ndarray) -> np.ndarray:
        """Indices of the members among x."""
        likely = np.flatnonzero(self.table[x >> self.shift]) if len(self.values) else np.zeros(0, np.intp)
        at = np.minimum(np.searchsorted(self.values, x[likely]), max(len(self.values) - 1, 0))
        return likely[self.values[at] == x[likely]] if len(likely) else likely
