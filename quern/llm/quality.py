"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

Words are runs of letters and digits, or runs of other signs; every word and every pair of neighbours is hashed into
one of 2**18 weights; a pair of equal words has a bucket of its own. Training sees a bounded sample of labelled documents as sparse vectors and keeps, per weight, the
two sums of the FTRL-proximal rule, with L1 and L2 terms. A whole text is scored as one sparse dot product, of which a long text
gives the terms piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import BASES, Rolling, held_out, mix64, saved, slices, sparse_rows, table, text_bytes, trainable, word_hashes

BITS = 18
#: The training sample: about so many labelled documents at most, chosen by a hash of the id.
SAMPLE = 4000
ALPHA, BETA, L1, L2, EPOCHS = 0.1, 1.0, 0.05, 0.5, 3
#: Bytes of text that are looked at at once; a longer run without white space counts as words of so many bytes.
PIECE = 1 << 20

_KIND = np.full(256, 2, np.uint8)  # 0: white space, 1: letters and digits, 2: other signs
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_AGAIN = mix64(np.array([11, 12], np.uint64))


class Grams:
    """Hashed word uni- and bigrams of many texts at once."""

    def __init__(self) -> None:
        self.roll = Rolling(BASES[0])

    def words(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash of each word, whether it is letters and digits (1) or other signs (2), first word of each text)."""
        if not len(data):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(len(off), np.int64)
        kind = _KIND[data]
        new = np.ones(len(data), bool)
        new[1:] = kind[1:] != kind[:-1]
        new[off[off < len(data)]] = True
        edges = np.append(np.flatnonzero(new), len(data))
        word = kind[edges[:-1]] > 0
        starts, ends = edges[:-1][word], edges[1:][word]
        return word_hashes(data, starts, ends, self.roll), kind[starts], np.searchsorted(starts, off)

    @staticmethod
    def pairs(one: np.ndarray, kind: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The hash of each word and the next one, or of it alone if it is a text's last."""
        two = mix64(one * np.uint64(3) + np.append(one[1:], np.uint64(0))[: len(one)])
        # a word that comes again at once, or after one sign, is one n-gram whatever the word
        two[np.flatnonzero(one[1:] == one[:-1])] = _AGAIN[0]
        again = np.flatnonzero((one[2:] == one[:-2]) & (kind[:-2] == 1) & (kind[1:-1] == 2))
        two[np.setdiff1d(again, last - 1)] = _AGAIN[1]
        two[last] = mix64(one[last] * np.uint64(3) + np.uint64(1))
        return two

    def __call__(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bucket of each word, bucket of it and the next word of its text or of it alone, first word of each text)."""
        one, kind, first = self.words(data, off)
        two = self.pairs(one, kind, first[1:][first[1:] > first[:-1]] - 1)
        shift = np.uint64(64 - BITS)
        return (one >> shift).astype(np.intp), (two >> shift).astype(np.intp), first

    def long(self, data: np.ndarray, size: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The buckets of one text's words and pairs, a piece of it at a time; the last two words of a piece wait for the next one."""
        one, kind = np.zeros(0, np.uint64), np.zeros(0, np.uint8)
        shift, at, n = np.uint64(64 - BITS), 0, len(data)
        while at < n:
            end = min(at + size, n)
            if end < n:
                gap = np.flatnonzero(_KIND[data[at:end]] == 0)
                end = at + int(gap[-1]) + 1 if len(gap) else end
            more, its, _ = self.words(data[at:end], np.array([0, end - at]))
            one, kind, at = np.concatenate([one, more]), np.concatenate([kind, its]), end
            m = len(one) if at == n else max(len(one) - 2, 0)
            two = self.pairs(one, kind, np.array([len(one) - 1] if at == n and m else [], np.int64))
            yield (one[:m] >> shift).astype(np.intp), (two[:m] >> shift).astype(np.intp)
            one, kind = one[m:], kind[m:]


def _per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(first) - 1)
    some = np.flatnonzero(first[1:] > first[:-1])
    if len(some):
        total[some] = np.add.reduceat(values, first[some])
    return total


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, off: np.ndarray, grams: Grams) -> np.ndarray:
        one, two, first = grams(data, off)
        n = np.diff(first)
        return self._score(_per_text(self.weights[one].astype(np.float64) + self.weights[two], first), n)

    def _score(self, total: np.ndarray, n: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(total / np.sqrt(np.maximum(n, 1)) + self.bias, -35, 35)))

    def of_long(self, data: np.ndarray, grams: Grams, size: int = PIECE) -> np.ndarray:
        """The score of one text, given as UTF-8 bytes, with memory for one piece of it at a time."""
        total, n = 0.0, 0
        for one, two in grams.long(data, size):
            total += self.weights[one].sum(dtype=np.float64) + self.weights[two].sum(dtype=np.float64)
            n += len(one)
        return self._score(np.array([total]), np.array([n]))

    def of_texts(self, texts: pa.Array, grams: Grams) -> np.ndarray:
        data, off = text_bytes(texts)
        return self.of_long(data, grams) if len(texts) == 1 and len(data) > PIECE else self.scores(data, off, grams)


def features(texts: pa.Array, grams: Grams) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, counts) of each text."""
    data, off = text_bytes(texts)
    if len(texts) == 1 and len(data) > PIECE:
        count = np.zeros(1 << BITS, np.int64)
        for one, two in grams.long(data):
            count += np.bincount(one, minlength=len(count)) + np.bincount(two, minlength=len(count))
        return [(np.flatnonzero(count), count[count > 0])]
    one, two, first = grams(data, off)
    return [np.unique(np.concatenate([one[a:b], two[a:b]]), return_counts=True) for a, b in zip(first[:-1], first[1:], strict=True)]


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(id, mark, y, keys, counts) of about `most` labelled documents that may teach; y is the mean of their labels.

    Ids are chosen by a hash; where these have more than twice `most` rows, so are their rows, by a hash of id and text. Features are
    computed where the texts are read; rows equal in id and text teach once.
    """
    known = labels.filter(trainable(F.col("doc_id")) & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("y"))
    n = known.count()
    lot = lambda *by: F.pmod(F.xxhash64(F.lit("quality"), *by), F.lit(1 << 30)) / float(1 << 30)
    chosen = saved(known.filter(lot("doc_id") < most / max(n, 1)), "labels")  # about `most` ids: every task may hold them
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    share = 2 * most / max(1, rows.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            for part in slices(batch, 3, PIECE):
                out = features(part.column(3), grams)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([k.astype("<i4").tobytes() for k, _ in out]), pa.array([c.astype("<f4").tobytes() for _, c in out])], names=["id", "y", "mark", "keys", "counts"])

    rows = rows.select("doc_id", "y", F.xxhash64("text").alias("mark"), "text").filter(lot("doc_id", "mark") < share)
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("string"))
    return rows.mapInArrow(run, "id string, y double, mark long, keys binary, counts binary").dropDuplicates(["id", "mark"])


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, seed: int = 7) -> Model:
    """Learn labels.quality from a bounded sample outside the held-out fold; with no label at all, every score is 0.5."""
    known, rows = sparse_rows(sample(docs, labels, most), ["id", "mark"])
    truth = known["y"].to_pylist()
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)  # the last is the bias

    def weight(at: np.ndarray) -> np.ndarray:
        return -np.sign(z[at]) * np.maximum(np.abs(z[at]) - np.where(at == size, 0, L1), 0) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            y, (keys, counts) = truth[i], rows[i]
            at, x = np.append(keys, size), np.append(counts / np.sqrt(max(1, counts.sum() / 2)), 1.0)
            w = weight(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weight(np.arange(size + 1))
    return Model(w[:-1].astype(np.float32), float(w[-1]))


def predict(docs: DataFrame, model: Model, text_col: str = "text", score: str = "score", predicted: str = "predicted") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from a score of 0.5) of every whole text; null and empty texts get the bias alone.

    A score of exactly 0.5 is predicted as 1. Repeated rows each give a row, an empty table none. A text longer than a MiB is taken in pieces of that size. All columns of docs are kept, except that one with the name of a new column gives way to it.
    """
    docs = docs.drop(score, predicted)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS floats
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, found = Grams(), shared.value
        for batch in batches:
            for part in slices(batch, at, PIECE):
                p = found.of_texts(part.column(at), grams)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*part.schema.names, score, predicted])

    schema = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType()), T.StructField(predicted, T.IntegerType())])
    return docs.mapInArrow(run, schema)


def predict_ids(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As predict(), but only the id (null as it is), score and predicted leave the Python worker; texts and other columns, whatever their names, do not."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, found = Grams(), shared.value
        for batch in batches:
            for part in slices(batch, 1, PIECE):
                score = found.of_texts(part.column(1), grams)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[id_col, "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = predict_ids(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
