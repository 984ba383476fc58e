"""Packing documents into fixed token windows by Karmarkar-Karp multiway differencing.

Every document is tokenised where it is read. Its full windows leave at once as windows of their own; the
rest of it, its tail, is packed together with the tails of many documents. Most tails stay whole; those that make up a fifth
of a group's tokens are cut into pieces of falling size, which fill what whole tails leave open. Tails and
pieces start as partial partitions over k windows (one slot filled), and the two partial partitions with the
largest imbalance are merged, fullest slot onto emptiest slot, until one remains. Whenever a window of the
result would exceed its capacity, the window count rises by one and the group is packed again.

Packing runs inside each input task: no shuffle, memory bounded by one group of windows, and a task that is run again
after a lost executor yields the same rows, since groups depend only on the order of its rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import slices, table

WINDOW = 1024
END = 0
#: Windows that are packed together, the slack left in each on average, and the smallest piece a tail is cut into.
GROUP, SLACK, LEAST = 64, 5, 16
#: The share of a group's tokens whose tails are cut; all other tails stay whole.
CUT = 0.2

SCHEMA = (
    "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def differencing(lengths: list[int], k: int) -> np.ndarray:
    """The window (0 to k - 1) of each item, by Karmarkar-Karp multiway differencing."""
    n = len(lengths)
    sums: list[np.ndarray] = []
    heap = []
    for i, size in enumerate(lengths):
        v = np.zeros(k, np.int64)
        v[0] = size
        sums.append(v)
        heap.append((-size, i))
    heapq.heapify(heap)
    merges = []
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        both = sums[a] + sums[b][::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        both -= both[-1]
        sums[a] = sums[b] = None
        sums.append(both)
        merges.append((a, b, order))
        heapq.heappush(heap, (-int(both[0]), len(sums) - 1))
    out = np.zeros(n, np.int64)
    names = {len(sums) - 1: np.arange(k)} if n else {}
    for j in range(len(sums) - 1, n - 1, -1):  # from the last merge back to the items
        mine, (a, b, order) = names.pop(j), merges[j - n]
        of_a = np.empty(k, np.int64)
        of_a[order] = mine
        names[a], names[b] = of_a, of_a[::-1]
    for i, mine in names.items():
        out[i] = mine[0]
    return out


def windows_of(lengths: list[int], capacity: int) -> np.ndarray:
    """The window of each item; windows are as few as differencing can fill without exceeding the capacity."""
    k = max(1, -(-sum(lengths) // capacity))
    while True:
        out = differencing(lengths, k)
        if np.bincount(out, weights=lengths).max(initial=0) <= capacity:
            return out
        k += 1


def tail_pieces(n: int, least: int = LEAST) -> list[int]:
    """Lengths that sum to n: halves of what is left, as small pieces let differencing level the windows."""
    out = []
    while n > 2 * least:
        out.append((n + 1) // 2)
        n -= out[-1]
    return [*out, n] if n else out


def cut_some(lengths: list[int], share: float = CUT) -> list[list[int]]:
    """The pieces of each tail: the first tails that make up `share` of all tokens are cut, the others are one piece."""
    wanted, out = share * sum(lengths), []
    for n in lengths:
        out.append(tail_pieces(n) if wanted > 0 else [n])
        wanted -= n
    return out


class Encoder:
    """Token ids of a text as the tokenizers library gives them for this file, without special tokens.

    With `added`, an added token's string in a text is that token, as by the library's own settings; otherwise it is ordinary text.

    The same vocabulary is run by tiktoken, whose ids are equal and which is several times as fast; a text that
    it cannot take (a run beyond its matcher's stack), and every text where the file asks for another way to split words than PLAIN, goes
    to the tokenizers library itself.
    """

    #: How the file must split texts for tiktoken to give its ids, and the pattern of that splitting.
    PLAIN = {"type": "ByteLevel", "add_prefix_space": False}
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str, added: bool = False):
        import json
        import re

        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self.slow = path, None
        special = {t["content"] for t in spec.get("added_tokens", [])}
        self.added = re.compile("|".join(map(re.escape, sorted(special)))) if added and special else None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
        rest = [b for b in range(256) if b not in set(shown)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(byte[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in special}
        split = spec.get("pre_tokenizer") or {}
        plain = all(split.get(k) == v for k, v in self.PLAIN.items()) and split.get("use_regex", True) and not spec.get("normalizer")
        self.fast = tiktoken.Encoding("file", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={}) if plain else None

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or (self.added is not None and self.added.search(text)):
            return self.exact(text)
        try:
            return self.fast.encode_ordinary(text)
        except BaseException as e:  # the matcher panics beyond its stack
            if isinstance(e, (KeyboardInterrupt, SystemExit)):
                raise
            return self.exact(text)

    def exact(self, text: str) -> list[int]:
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
            self.slow.encode_special_tokens = self.added is None
        return self.slow.encode(text, add_special_tokens=False).ids


def pack(
    docs: DataFrame,
    tokenizer: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    group: int = GROUP,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of documents in windows of at most `window` tokens.

    One row per piece: the id column, start and length in the document's ids (its tokens, then id 0), ids_crc32,
    doc_tokens, sequence_id and offset there; with_ids adds the ids themselves. A null or empty text is the single
    id 0; a null id is carried as it is. Repeated rows are packed each on its own. Other columns of `docs`, whatever their names, are
    not carried. No rows give no rows. A very long text is tokenised whole, as ids depend on what precedes them, and its
    full windows leave in turn. Items of equal length keep the order in which they were read.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, {SCHEMA}" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer, added=True)
        next_id = TaskContext.get().partitionId() << 33
        waiting: list[tuple] = []  # tails: (id, start, ids, tokens of the document)
        total, out = 0, []

        def put(doc, start, ids, tokens, seq, offset):
            row = (doc, start, len(ids), zlib.crc32(ids.tobytes()), tokens, seq, offset)
            out.append((*row, ids.astype(np.int32)) if with_ids else row)

        def level():
            nonlocal next_id, total
            if waiting:
                cuts = cut_some([len(w[2]) for w in waiting])
                where = windows_of([n for sizes in cuts for n in sizes], window)
                used = {int(w): i for i, w in enumerate(np.unique(where))}
                at, window_of = dict.fromkeys(used, 0), iter(where.tolist())
                for sizes, (doc, start, ids, tokens) in zip(cuts, waiting, strict=True):
                    first = 0
                    for size in sizes:
                        w = next(window_of)
                        put(doc, start + first, ids[first : first + size], tokens, next_id + used[w], at[w])
                        at[w] += size
                        first += size
                next_id += len(used)
            waiting.clear()
            total = 0

        def rows() -> pa.RecordBatch:
            columns = [list(c) for c in zip(*out, strict=True)]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
            out.clear()
            return batch

        id_arrow = None
        names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
        for batch in batches:
            id_arrow = batch.schema.types[0]
            types = [id_arrow] + [pa.int64()] * 6 + [pa.list_(pa.int32())] * with_ids
            for part in slices(batch, 1):
                for doc, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    ids = np.array([*encode(text.as_py() or ""), END], "<u4")
                    n, full = len(ids), len(ids) // window * window
                    for start in range(0, full, window):
                        put(doc, start, ids[start : start + window], n, next_id, 0)
                        next_id += 1
                    if total + n - full > group * (window - SLACK):
                        level()
                    if n > full:
                        waiting.append((doc, full, ids[full:], n))
                    total += n - full
                    if len(out) >= 20_000:
                        yield rows()
            if out:
                yield rows()
        level()
        if out:
            yield rows()

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), byte_bpe())
