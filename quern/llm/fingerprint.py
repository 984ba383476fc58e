"""Document fingerprints: a quartile digest of hashed byte triplets, compared by a bounded difference score.

A text's byte triplets are counted in 256 hashed buckets. The digest holds the text's length on a logarithmic scale
and, for each bucket, which quartile of the 256 counts its count lies in (two bits). Two digests differ by a sum over
buckets of a step that grows with the distance of quartiles, plus the distance of lengths; likeness is one less that
sum as a share of the bound, never below 0.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.common import saved, slices, table

BUCKETS = 256
#: The difference that buckets 0 to 3 quartiles apart add, and the sum at which two digests have nothing in common:
#: about that of independent quartiles, 256 * (0 * 4 + 1 * 6 + 2 * 4 + 6 * 2) / 16.
STEP = np.array([0, 1, 2, 6], np.int64)
BOUND = 416
#: Bytes of a long text that are looked at at once.
PIECE = 1 << 20


def _keys(data: np.ndarray) -> np.ndarray:
    """The bucket of each triplet."""
    wide = data.astype(np.uint32)
    key = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
    key *= np.uint32(0x9E3779B1)
    key >>= np.uint32(24)
    return key.astype(np.intp)


def _counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Bucket counts of the triplets within each text; those of a single text are counted piece by piece."""
    n = len(off) - 1
    if len(data) < 3:
        return np.zeros((n, BUCKETS), np.int64)
    if n == 1:
        parts = (_keys(data[i : i + PIECE + 2]) for i in range(0, len(data) - 2, PIECE))
        return sum(np.bincount(k, minlength=BUCKETS) for k in parts)[None, :]
    key = _keys(data)
    at = np.repeat(np.arange(n), np.diff(off))[: len(key)] * BUCKETS + key
    keep = np.ones(len(key), bool)
    for back in (2, 1):  # a triplet that would run into the next text
        last = off[1:] - back
        keep[last[(last >= 0) & (last < len(key))]] = False
    return np.bincount(at[keep], minlength=n * BUCKETS).reshape(n, BUCKETS)


def digests(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(quartile codes, one row of 256 for each text; length classes)."""
    counts = _counts(data, off)
    ranked = np.sort(counts, axis=1)
    codes = np.zeros(counts.shape, np.uint8)
    for q in (BUCKETS // 4, BUCKETS // 2, BUCKETS * 3 // 4):
        codes += counts > ranked[:, q - 1 : q]
    size = np.minimum(255, np.round(12 * np.log1p(np.diff(off)))).astype(np.int64)
    return codes, size


def encoded(codes: np.ndarray, size: np.ndarray) -> list[str]:
    """Digests as text: two hexadecimal digits of length, then 128 of quartiles."""
    four = codes.reshape(len(codes), -1, 4)
    packed = four[:, :, 0] << 6 | four[:, :, 1] << 4 | four[:, :, 2] << 2 | four[:, :, 3]
    return [f"{n:02x}{row.tobytes().hex()}" for n, row in zip(size.tolist(), packed, strict=True)]


def decoded(digest: list[str]) -> tuple[np.ndarray, np.ndarray]:
    packed = np.frombuffer(bytes.fromhex("".join(d[2:] for d in digest)), np.uint8).reshape(len(digest), -1)
    codes = np.stack([packed >> s & 3 for s in (6, 4, 2, 0)], axis=2).reshape(len(digest), -1)
    return codes, np.array([int(d[:2], 16) for d in digest], np.int64)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """0 to 1 for each pair of digests; 1 for equal ones."""
    apart = STEP[np.abs(a[0].astype(np.int8) - b[0].astype(np.int8))].sum(axis=1) + np.abs(a[1] - b[1])
    return 1 - np.minimum(apart, BOUND) / BOUND


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars and fingerprint of every text; a null text counts as empty. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 2 << 20):
                texts = [t or "" for t in part.column(1).to_pylist()]
                marks = encoded(*digests(*joined(texts)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, texts), pa.int64()), pa.array(marks, pa.string())], names=[id_col, "n_chars", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, n_chars long, fingerprint string")


def edited(text: str, other: str) -> str:
    """The last third of the code points replaced by the first as many (or all) of the other text."""
    cut = len(text) // 3
    return text[: len(text) - cut] + other[:cut]


RESULT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
RESULT_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(ids: list, texts: list[str], following: list[str]) -> list[pa.Array]:
    """The columns of RESULT for each text and the one that follows it."""
    changed = [edited(t, o) for t, o in zip(texts, following, strict=True)]
    new = digests(*joined(changed))
    if following[:-1] == texts[1:]:  # neighbours in order: each text is digested once
        codes, size = digests(*joined([*texts, following[-1]]))
        own, after = (codes[:-1], size[:-1]), (codes[1:], size[1:])
    else:
        own, after = digests(*joined(texts)), digests(*joined(following))
    return [
        pa.array(ids, pa.int64()), pa.array(map(len, texts), pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]), pa.array(encoded(*own)), pa.array(encoded(*new)),
        pa.array(likeness(own, new)), pa.array(likeness(own, after)),
    ]


def edit_probe(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, made with the next document in descending doc_id.

    Documents are dealt out by ranges of doc_id once, and each task compares its neighbours in order. The one
    neighbour it lacks is the first document of the range below: each task also gives its first and last document,
    as many rows as there are ranges, and those pairs are compared afterwards. Rows with equal doc_id follow each
    other by a hash of their text, and repeated rows may lie in several ranges; a null doc_id comes last; a null text is empty; no rows give no rows. Other columns, whatever
    their names, are not carried. A very long text is counted piece by piece.
    """
    kinds = "kind int, part int, text string"
    mixed = [*RESULT, "kind", "part", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the document whose follower has not come yet
        part_id = TaskContext.get().partitionId()  # ranges are numbered in order

        def ends(kind: int) -> pa.RecordBatch:
            doc, _, text = held
            nothing = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), *nothing, pa.array([kind], pa.int32()), pa.array([part_id], pa.int32()), pa.array([text], pa.string())], names=mixed)

        for batch in batches:
            for part in slices(batch, 2, 1 << 20):
                rows = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), [t or "" for t in part.column(2).to_pylist()], strict=True))
                if held is None:
                    held, rows = rows[0], rows[1:]
                    yield ends(1)
                if not rows:
                    continue
                rows = [held, *rows]
                held = rows.pop()
                texts = [r[2] for r in rows]
                columns = _compared([r[0] for r in rows], texts, [*texts[1:], held[2]])
                n = len(rows)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.zeros(n, np.int32)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())], names=mixed)
        if held is not None:
            yield ends(2)

    order = [F.desc_nulls_last("doc_id"), F.desc("mark"), F.asc("lot")]
    by = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("mark"), F.col("text").cast("string"), F.monotonically_increasing_id().alias("lot"))
    done = by.repartitionByRange(*order).sortWithinPartitions(*order).drop("lot")
    done = saved(done.mapInArrow(run, f"{RESULT_SCHEMA}, {kinds}"), "edits")

    # One first and one last document of each range: the last of one meets the first of the next. Only their numbers are put in order.
    every = done.filter("kind = 1").select("part", F.row_number().over(Window.orderBy("part")).alias("place"), F.count("*").over(Window.partitionBy()).alias("ranges"))
    firsts = done.filter("kind = 1").join(every, "part").select("place", F.col("text").alias("after"))
    lasts = done.filter("kind = 2").join(every, "part").select("doc_id", "text", (F.col("place") % F.col("ranges") + 1).alias("place"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, texts, after = (batch.column(i).to_pylist() for i in range(3))
                yield pa.RecordBatch.from_arrays(_compared(ids, texts, after), names=RESULT)

    closed = lasts.join(firsts, "place").select("doc_id", "text", "after").mapInArrow(close, RESULT_SCHEMA)
    return done.filter("kind = 0").select(*RESULT).unionByName(closed)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_probe(table(spark, sf_dir, "documents"))
