"""Language identification: averaged embeddings of hashed subwords with a linear softmax, trained here by SGD.

A text's features are the byte n-grams of its lower-cased form, hashed into buckets. Training averages the buckets'
embeddings over the text and learns embeddings and softmax weights together by stochastic gradient descent in numpy.
For prediction each bucket's embedding is multiplied into the softmax weights once, so that scoring a whole text is a
lookup and a mean; a long text is taken piece by piece and its pieces are summed. A temperature calibrates the probabilities on documents that training did not see, and the same
documents set the score under which a prediction is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import held_out, saved, slices, sparse_rows, table, text_bytes, trainable

BUCKETS, DIM = 1 << 16, 16
NGRAMS = (2, 3, 4)
#: The training sample: about so many labelled documents of each language, fewer where so many in all would be exceeded, two at least.
PER_LANGUAGE, SAMPLE = 500, 20_000
#: Bytes of text that are looked at at once.
PIECE = 1 << 20
EPOCHS, RATE = 6, 0.4
#: The share of true predictions that calibration lets rejection turn away.
TURNED_AWAY = 0.01

_LETTER = regex.compile(r"\p{L}")


def keys(data: np.ndarray) -> list[np.ndarray]:
    """Bucket numbers by gram length, for each byte that max(NGRAMS) - 1 others follow."""
    wide = data.astype(np.uint32)
    n = max(len(wide) - max(NGRAMS) + 1, 0)
    out, key = [], np.zeros(n, np.uint32)
    for i in range(max(NGRAMS)):
        key = (key << np.uint32(8)) | wide[i : i + n]
        if i + 1 in NGRAMS:
            out.append(((key * np.uint32(0x9E3779B1) + np.uint32((i * 0x85EBCA6B) & 0xFFFFFFFF)) >> np.uint32(16)).astype(np.intp) & (BUCKETS - 1))
    return out


PAD = b" " * max(NGRAMS)  # a text's last grams meet a word's end, never the next text


def grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Bucket numbers by gram length, for each byte of all texts; and where each text's bytes start and end."""
    raw = [t.lower().encode() for t in texts]
    size = np.array([len(r) for r in raw], np.int64)
    start = np.cumsum(size + len(PAD)) - size - len(PAD)
    return keys(np.frombuffer(PAD.join([*raw, b""]), np.uint8)), start, start + size


def pieces(data: np.ndarray, size: int = PIECE) -> Iterator[str]:
    """A text's UTF-8 bytes as strings of at most `size` bytes, cut behind a space or line end, or else between two characters."""
    at, n = 0, len(data)
    while at < n:
        end = min(at + size, n)
        if end < n:
            gap = np.flatnonzero((data[at:end] == 0x20) | (data[at:end] == 0x0A))
            if len(gap):
                end = at + int(gap[-1]) + 1
            while end > at + 1 and (data[end] & 0xC0) == 0x80:
                end -= 1
        yield data[at:end].tobytes().decode()
        at = end


def long_grams(data: np.ndarray, size: int = PIECE) -> Iterator[list[np.ndarray]]:
    """As grams of one text, a piece of it at a time; the bytes whose grams reach into the next piece wait for it."""
    rest = b""
    for piece in pieces(data, size):
        rest += piece.lower().encode()
        got = keys(np.frombuffer(rest, np.uint8))
        rest = rest[len(got[0]) :]
        yield got
    left = keys(np.frombuffer(rest + PAD, np.uint8))
    yield [k[: len(rest)] for k in left]


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # what each bucket adds to each language's logit, or its embedding where there are more languages than dimensions
    head: np.ndarray | None  # in the latter case, from embeddings to logits
    bias: np.ndarray
    reject: float

    def _of_means(self, mean: np.ndarray) -> np.ndarray:
        return softmax((mean if self.head is None else mean @ self.head) + self.bias)

    def probabilities(self, texts: list[str]) -> np.ndarray:
        found, start, end = grams(texts)
        total = np.zeros((len(texts), self.table.shape[1]))
        some = np.flatnonzero(end > start)
        if len(some):
            edges = np.stack([start[some], end[some]], axis=1).ravel()
            for key in found:
                at = np.minimum(edges, len(key) - 1)
                total[some] += np.add.reduceat(self.table[key], at, axis=0)[::2]
            total[some] /= ((end - start)[some] * len(found))[:, None]
        return self._of_means(total)

    def of_long(self, data: np.ndarray, size: int = PIECE) -> np.ndarray:
        """The probabilities of one text, given as UTF-8 bytes, with memory for one piece of it at a time."""
        total, n = np.zeros(self.table.shape[1]), 0
        for found in long_grams(data, size):
            for key in found:
                total += self.table[key].sum(axis=0, dtype=np.float64)
                n += len(key)
        return self._of_means(total[None, :] / max(n, 1))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def features(part: pa.RecordBatch, column: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, counts) of each text of a batch."""
    if len(part) == 1 and part.column(column).nbytes > PIECE:
        count = np.zeros(BUCKETS, np.int64)
        for found in long_grams(text_bytes(part.column(column))[0]):
            for key in found:
                count += np.bincount(key, minlength=BUCKETS)
        return [(np.flatnonzero(count), count[count > 0])]
    found, start, end = grams(part.column(column).to_pylist())
    return [np.unique(np.concatenate([k[a:b] for k in found]), return_counts=True) for a, b in zip(start, end, strict=True)]


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, most: int = SAMPLE) -> DataFrame:
    """(id, lang, mark, keys, counts): features of about per_language trainable documents of each language (`most` in all), chosen by a hash of id and text.

    Features are computed where the texts are read; documents equal in id, language and text teach once.
    """
    rows = docs.filter(trainable(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.select(F.col("doc_id").cast("string").alias("id"), "lang", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("mark"))
    counts = saved(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    quota = max(2.0, min(per_language, most / max(1, counts.count())))
    lot = F.pmod(F.xxhash64(F.lit("langid"), "id", "mark"), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.join(counts, "lang").filter(lot < F.lit(quota) / F.col("n")).select("id", "lang", "mark", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 3, PIECE):
                out = features(part, 3)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([k.astype("<i4").tobytes() for k, _ in out]), pa.array([c.astype("<f4").tobytes() for _, c in out])], names=["id", "lang", "mark", "keys", "counts"])

    found = chosen.mapInArrow(run, "id string, lang string, mark long, keys binary, counts binary")
    return found.dropDuplicates(["id", "lang", "mark"])


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, seed: int = 7) -> Model | None:
    """A model of the languages in docs (doc_id, lang, text); None where nothing is labelled.

    Only documents outside the held-out fold teach it; of them a bounded sample, whose features are computed where
    the texts are. A fifth of the sample is kept from training, for the temperature and the rejection score.
    """
    known, rows = sparse_rows(sample(docs, per_language).filter("octet_length(keys) > 0"), ["lang", "id", "mark"])
    if not rows:
        return None
    labels = known["lang"].to_pylist()
    names = sorted(set(labels))
    number = {x: i for i, x in enumerate(names)}
    data = [(number[x], *r) for x, r in zip(labels, rows, strict=True)]
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(data))
    kept, tuned = order[len(order) // 5 :], order[: len(order) // 5]
    c = len(names)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    out, bias = np.zeros((DIM, c)), np.zeros(c)
    steps, done = EPOCHS * len(kept), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(kept):
            y, keys, counts = data[i]
            x = counts / counts.sum()
            hidden = x @ emb[keys]
            slope = softmax(hidden @ out + bias)
            slope[y] -= 1
            rate = RATE * (1 - done / steps)
            # a text spreads its step over all its buckets; divided by their squared weights, the mean moves by `rate`
            emb[keys] -= np.outer(x * (rate / (x @ x)), out @ slope)
            out -= rate * np.outer(hidden, slope)
            bias -= rate * 0.1 * slope
            done += 1
    weights = emb @ out if c <= DIM else None
    held = tuned if len(tuned) else kept
    mean = lambda i: data[i][2] / data[i][2].sum()
    logits = np.array([mean(i) @ weights[data[i][1]] + bias if c <= DIM else mean(i) @ emb[data[i][1]] @ out + bias for i in held])
    truth = np.array([data[i][0] for i in held])
    pick = np.arange(len(held))
    scales = np.geomspace(0.1, 10, 41)
    best = min(scales, key=lambda s: -np.log(softmax(logits * s)[pick, truth] + 1e-12).mean())
    sure = softmax(logits * best)[pick, truth]
    # whichever is smaller: logits of every bucket, or its embedding and the weights
    folded = c <= DIM
    return Model(names, ((weights * best) if folded else emb).astype(np.float32), None if folded else out * best, bias * best, float(np.quantile(sure, TURNED_AWAY)))


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score and rejected of every whole text.

    A null text, or one without a letter, is `und` with score 0 and rejected; so is every text where the model is None. Of languages that
    are equally likely the first by name is predicted. Repeated rows each give a row, an empty table none; a null id is carried as it is, other columns, whatever their
    names, are not. A text longer than a MiB is taken in pieces of that size.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # BUCKETS x DIM floats at most, and DIM for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in batches:
            for part in slices(batch, 1, PIECE):
                n = len(part)
                lang, score = np.full(n, "und", object), np.zeros(n)
                if n == 1 and part.column(1).nbytes > PIECE:
                    data = text_bytes(part.column(1))[0]
                    known = [0] if found and any(_LETTER.search(t) for t in pieces(data)) else []
                    p = found.of_long(data) if known else None
                else:
                    texts = part.column(1).to_pylist()
                    known = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if found else []
                    p = found.probabilities([texts[i] for i in known]) if known else None
                if known:
                    lang[known], score[known] = np.array(found.languages, object)[p.argmax(axis=1)], p.max(axis=1)
                refused = (lang == "und") | (score < found.reject if found else True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(refused.astype(bool))], names=[id_col, "lang_pred", "score", "rejected"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, rejected boolean")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
