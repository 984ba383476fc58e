"""Substring dedup by relative Lempel-Ziv parsing of all documents against an index of all blocks.

The corpus is dealt out in blocks of bounded size, each of which is a reference for all others and itself. Of each window of
35 words the least hash of a six-word gram is its anchor, so that equal windows have equal anchors wherever they stand. From anchor to
anchor a document falls into phrases, and the index holds the first place of every phrase in the corpus.
A document is parsed greedily: a factor begins at a phrase that has an earlier place, its source, and is extended phrase by phrase for as long as
the text follows its source; then the next one begins. A factor of 35 words or more is a duplicate span, in the document and in its source.

What a factor's ends cut off is checked word by word: a window that no factor holds, and whose anchor occurs elsewhere, has its 128-bit key compared with
those of all other such windows, the sources' among them. Hence every window that occurs twice lies in a factor, in a
factor's source, or is found by its key, and no other does.

Blocks exchange phrases (about 7 for 100 words), then factors and the keys of windows at their ends. Each block and each range
of keys is one task's group; phrases and keys are made distinct within a block before they leave it, so a passage that a third of all documents share
counts once for each block. The documents are shuffled once, and the three passes over them read that same shuffle.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Members, Rolling, WordHasher, mix64, sliding, table, text_bytes

#: Words of a window and of an anchor's gram; bytes of text in a block, on average.
WINDOW, GRAM = 35, 6
BLOCK = 3 << 20
#: Blocks for each range of keys, so that a block sends few and long lists of keys and a range is of bounded size.
SHARE = 4


class Parser:
    """The hashes of one block's documents."""

    def __init__(self, texts: pa.Array, window: int, gram: int, hasher: WordHasher, rolls: list[Rolling]):
        self.window, self.gram = window, gram
        self.first, self.second, self.start = hasher(*text_bytes(texts))
        n = len(self.first)
        self.words = np.diff(self.start)
        self.rolls = rolls
        self.valid = np.zeros(max(n - window + 1, 0), bool)  # where a window starts within a document
        long = np.flatnonzero(self.words >= window)
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, self.start[long], 1)
        np.add.at(edge, self.start[long + 1] - window + 1, -1)
        self.valid[:] = np.cumsum(edge)[: len(self.valid)] > 0
        self.prefix = [r.prefix(h) for r, h in zip(rolls, (self.first, self.second), strict=True)]
        self.span = window - gram + 1
        at = np.arange(max(n - gram + 1, 0))
        self.grams = mix64(rolls[0].ranges(self.prefix[0], at, at + gram))
        self.anchor = sliding(self.grams, self.span)  # of each window
        self.anchor[~self.valid] = 0

    def phrases(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word, anchor, key, length) of each place whose gram is some window's anchor: its first word, the gram's hash, a hash of the words
        from here to the end of the document's next such gram, and their number; the last place of a document has key and length 0."""
        n = len(self.grams)
        if not len(self.anchor):
            return (np.zeros(0, np.int64), *(np.zeros(0, np.uint64),) * 2, np.zeros(0, np.int64))
        around = np.concatenate([np.zeros(self.span - 1, np.uint64), self.anchor, np.zeros(self.span - 1, np.uint64)])
        top = sliding(around, self.span, least=False)[:n]  # over the windows that hold a gram
        at = np.flatnonzero((top == self.grams) & (top > 0))
        doc = np.searchsorted(self.start, at, side="right")
        more = np.flatnonzero(doc[1:] == doc[:-1])
        length, key = np.zeros(len(at), np.int64), np.zeros(len(at), np.uint64)
        length[more] = at[more + 1] - at[more] + self.gram
        key[more] = mix64(self.rolls[1].ranges(self.prefix[1], at[more], at[more] + length[more]) + length[more].astype(np.uint64)) | np.uint64(1)
        return at, self.grams[at], key, length

    def factors(self, block: int, known: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, words, source) of each factor of the greedy parse; known: anchors, phrase keys and first places, from the index.

        A place is a block's number and a word there; a phrase whose first place is its own begins no factor.
        """
        at, anchor, key, length = self.phrases()
        own = places(block, at)
        anchors, keys, first = known
        both = mix64(anchors) + keys
        order = np.argsort(both, kind="stable")
        mine = mix64(anchor) + key
        hit = np.minimum(np.searchsorted(both[order], mine), max(len(both) - 1, 0))
        source = own.copy()
        if len(both):
            same = (both[order][hit] == mine) & (length > 0)
            source[same] = first[order][hit[same]]
        copied = source != own
        # a factor goes on where the next phrase has the place that follows in the source
        on = copied[1:] & copied[:-1] & (length[:-1] > 0) & (source[1:] - source[:-1] == at[1:] - at[:-1]) & (at[1:] - at[:-1] + self.gram == length[:-1])
        begins = np.flatnonzero(copied & ~np.concatenate([[False], on]))[: len(at)]
        ends = np.flatnonzero(copied & ~np.concatenate([on, [False]]))
        return at[begins], at[ends] + length[ends] - at[begins], source[begins]

    def open_windows(self, known: np.ndarray, first: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The starts of the windows whose anchor is known and which no factor (first, words) holds."""
        at = Members(known).where(self.anchor)
        at = at[self.valid[at]]
        held = np.zeros(len(self.first) + 1, np.int64)
        long = words >= self.window
        np.add.at(held, first[long], 1)
        np.add.at(held, first[long] + words[long] - self.window + 1, -1)
        return at[np.cumsum(held)[at] == 0]

    def keys(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(mix64(r.ranges(p, at, at + self.window)) for r, p in zip(self.rolls, self.prefix, strict=True))

    def covered(self, at: np.ndarray, first: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Whether each word lies in one of the windows that start at `at`, or in a span (first, words)."""
        edge = np.zeros(len(self.first) + 1, np.int64)
        edge[at] += 1
        np.add.at(edge, at + self.window, -1)
        np.add.at(edge, first, 1)
        np.add.at(edge, first + words, -1)
        return np.cumsum(edge[:-1]) > 0


def places(block: int, words: np.ndarray) -> np.ndarray:
    return (block << 32) + words.astype(np.int64)


def _blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _array(rows: pa.Table, name: str, kind: type = np.uint64) -> np.ndarray:
    return np.frombuffer(b"".join(rows[name].to_pylist()), kind)


#: What blocks and ranges of keys send each other: pairs of hashes with places, or spans; block is the sender or the one addressed.
KEYS, SPANS = 0, 1
SENT = "part long, block long, kind int, k0 binary, k1 binary, k2 binary"
_ARROW = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()), *((f"k{i}", pa.binary()) for i in range(3))])


def _by_group(to: np.ndarray, groups: np.ndarray, columns: list[np.ndarray], row) -> list[dict]:
    """One row for each of the values in groups that occurs in `to` (sorted), with the columns' parts as blobs."""
    cuts = np.append(np.searchsorted(to, groups), len(to))
    none = {f"k{i}": b"" for i in range(3)}
    return [{**row(g), **none, **{f"k{i}": _blob(c[a:b]) for i, c in enumerate(columns)}} for g, a, b in zip(groups.tolist(), cuts[:-1], cuts[1:], strict=True)]


def _dealt(block: int, parts: int, one: np.ndarray, two: np.ndarray, place: np.ndarray) -> list[dict]:
    """A block's distinct pairs of hashes by ranges of the first: k0, k1 and k2, which is the first place, with its sign bit set if the pair is met again here."""
    order = np.lexsort((place, two, one))
    one, two, place = one[order], two[order], place[order]
    new = np.ones(len(order), bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    at = np.flatnonzero(new)
    again = np.diff(np.append(at, len(order))) > 1
    one, two, place = one[at], two[at], np.where(again, ~place[at], place[at])
    part = ((one >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    return _by_group(part, np.unique(part), [one, two, place], lambda g: {"part": g, "block": block, "kind": KEYS})


class _Range:
    """All pairs of one range of keys, from all blocks, in order of the pairs and then of their places."""

    def __init__(self, rows: pa.Table):
        sent = [len(b) // 8 for b in rows["k0"].to_pylist()]
        self.one, self.two, place = _array(rows, "k0"), _array(rows, "k1"), _array(rows, "k2", np.int64)
        self.again, self.place = place < 0, np.where(place < 0, ~place, place)
        self.owner = np.repeat(rows["block"].to_numpy(), sent)
        order = np.lexsort((self.place, self.two, self.one))
        for name in ("one", "two", "again", "place", "owner"):
            setattr(self, name, getattr(self, name)[order])

    def often(self, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether the keys at each place occur at two or more places, the place of the first of equal ones)."""
        if not len(self.one):
            return np.zeros(0, bool), np.zeros(0, np.int64)
        new = np.ones(len(self.one), bool)
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        group = np.cumsum(new) - 1
        count = np.bincount(group) + np.bincount(group, weights=self.again)
        return (count > 1)[group], self.place[np.flatnonzero(new)][group]

    def back(self, keep: np.ndarray, *columns: np.ndarray) -> list[dict]:
        """To each block what is kept of its pairs."""
        at = np.flatnonzero(keep)
        at = at[np.argsort(self.owner[at], kind="stable")]
        return _by_group(self.owner[at], np.unique(self.owner[at]), [c[at] for c in columns], lambda g: {"part": None, "block": g, "kind": KEYS})


def _table(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, _ARROW)


def _of(rows: pa.Table, kind: int) -> pa.Table:
    return rows.filter(pa.array(rows["kind"].to_numpy() == kind, pa.bool_())) if rows.num_rows else rows


def dedup_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = WINDOW, gram: int = GRAM, block: int = BLOCK, with_text: bool = True) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, spans, kept): what is left of each document.

    Words are runs of anything but space and U+0009 to U+000D. Every word goes that a window of `window` words
    covers whose word sequence also starts at another place, in the same document or another one, repeated rows included. spans lists
    the removed words as (first, end) within the document; kept, with with_text, holds the other words joined by one space.
    A null or empty text has no words; a null id is carried as it is. Other columns, whatever their names, are not carried; no rows give no
    rows. A very long text is one block. Of equal phrases the first in order of block and place is the source.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(1, -(-total // block))
    parts = max(1, blocks // SHARE)
    d = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    # rows equal in id and text fall into several blocks where they are read by several tasks
    d = d.withColumn("block", F.pmod(F.xxhash64("id", "text", F.spark_partition_id()), F.lit(blocks)))
    kind = d.schema["id"].dataType.simpleString()

    def tools() -> tuple:
        from quern.llm.common import BASES

        return window, gram, WordHasher(), [Rolling(BASES[1]), Rolling(BASES[0])]

    def ordered(t: pa.Table) -> pa.Table:
        """The block's rows in one order in all passes, as places are numbers of words."""
        return t.sort_by([("id", "ascending"), ("text", "ascending")])

    def joined(t: pa.Table) -> pa.Array:
        c = t["text"].combine_chunks()
        return pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c

    def index(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        at, anchor, phrase, _ = Parser(joined(ordered(t)), *tools()).phrases()
        return _table(_dealt(key[0].as_py(), parts, anchor, phrase, places(key[0].as_py(), at)))

    def firsts(t: pa.Table) -> pa.Table:
        r = _Range(t)
        shared, _ = r.often(r.one)
        _, first = r.often(r.one, r.two)
        return _table(r.back(shared, r.one, r.two, first))

    def factor(t: pa.Table, known: pa.Table) -> pa.Table:
        if not t.num_rows or not known.num_rows:
            return _table([])
        own = t["block"][0].as_py()
        p = Parser(joined(ordered(t)), *tools())
        known = (_array(known, "k0"), _array(known, "k1"), _array(known, "k2", np.int64))
        first, words, source = p.factors(own, known)
        asked = p.open_windows(known[0], first, words)
        rows = _dealt(own, parts, *p.keys(asked), places(own, asked))
        long = words >= window
        spans = np.stack([np.concatenate([places(own, first[long]), source[long]]), np.tile(words[long], 2)], axis=1)
        spans = np.unique(spans, axis=0)
        to = (spans[:, 0] >> 32) % parts
        spans, to = spans[np.argsort(to, kind="stable")], np.sort(to)
        rows += _by_group(to, np.unique(to), [spans[:, 0], spans[:, 1]], lambda g: {"part": g, "block": own, "kind": SPANS})
        return _table(rows)

    def decide(t: pa.Table) -> pa.Table:
        r, s = _Range(_of(t, KEYS)), _of(t, SPANS)
        twice, _ = r.often(r.one, r.two)
        spans = np.unique(np.stack([_array(s, "k0", np.int64), _array(s, "k1", np.int64)], axis=1), axis=0)
        to = spans[:, 0] >> 32
        rows = _by_group(to, np.unique(to), [spans[:, 0], spans[:, 1]], lambda g: {"part": None, "block": g, "kind": SPANS})
        return _table(r.back(twice, r.one, r.two) + rows)

    def remove(t: pa.Table, known: pa.Table) -> pa.Table:
        t = ordered(t)
        texts = joined(t)
        p = Parser(texts, *tools())
        keys, spans = _of(known, KEYS), _of(known, SPANS)
        at = np.zeros(0, np.intp)
        if keys.num_rows:
            a, b = _array(keys, "k0"), _array(keys, "k1")
            every = np.flatnonzero(p.valid)
            one, two = p.keys(every)
            hit = Members(a).where(one)
            # with both hashes mixed, a pair is a member where its mixture is
            both = Members(mix64(a) + b)
            hit = hit[both.where(mix64(one[hit]) + two[hit])]
            at = every[hit]
        first, words = _array(spans, "k0", np.int64) & 0xFFFFFFFF, _array(spans, "k1", np.int64)
        gone = p.covered(at, first, words)
        n_gone = np.add.reduceat(np.append(gone, False).astype(np.int64), p.start[:-1]) if len(p.words) else np.zeros(0, np.int64)
        n_gone[p.words == 0] = 0
        sha, kept, spans = [], [], []
        for i, raw in enumerate(texts.to_pylist()):
            words = raw.encode().split()
            if n_gone[i]:
                mine = gone[p.start[i] : p.start[i + 1]]
                words = list(compress(words, ~mine))
                edge = np.flatnonzero(np.diff(np.concatenate([[0], mine.astype(np.int8), [0]]))).reshape(-1, 2)
                spans.append([{"first": a, "end": b} for a, b in edge.tolist()])
            else:
                spans.append([])
            left = b" ".join(words)
            sha.append(hashlib.sha256(left).hexdigest())
            if with_text:
                kept.append(left.decode())
        out = {"id": t["id"], "n_words": pa.array(p.words, pa.int64()), "n_removed": pa.array(n_gone, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
        out["spans"] = pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))
        return pa.table({**out, "kept": pa.array(kept, pa.string())} if with_text else out)

    phrases = d.groupBy("block").applyInArrow(index, SENT)
    known = phrases.groupBy("part").applyInArrow(firsts, SENT)
    found = d.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(factor, SENT)
    again = found.groupBy("part").applyInArrow(decide, SENT)
    schema = f"id {kind}, n_words long, n_removed long, kept_sha256 string, spans array<struct<first:long,end:long>>" + ", kept string" * with_text
    return d.groupBy("block").cogroup(again.groupBy("block")).applyInArrow(remove, schema).withColumnRenamed("id", id_col)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_spans(table(spark, sf_dir, "documents"), with_text=False)
    return done.select("doc_id", "n_words", "n_removed", "kept_sha256")
