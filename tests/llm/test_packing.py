import functools
import zlib

import numpy as np
import pytest
from helpers import SF, empty, odd, odd_rows

from quern.llm import packing
from quern.llm.common import table

tokenizers = pytest.importorskip("tokenizers")


@functools.cache
def library():
    return tokenizers.Tokenizer.from_file(packing.byte_bpe())


def ids_of(text):
    return [*library().encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, texts):
    """Every id of every document once, windows gapless and within their capacity; the share of places that are used."""
    seqs, docs = {}, {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        docs.setdefault(r["doc_id"], []).append(r)
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
    for doc, pieces in docs.items():
        left = [np.array(ids_of(t), "<u4") for t in texts[doc]]
        assert sum(p["length"] for p in pieces) == sum(map(len, left))
        for p in pieces:
            assert any(len(i) == p["doc_tokens"] and zlib.crc32(i[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for i in left)
        if len(left) == 1:
            ends = sorted((p["start"], p["start"] + p["length"]) for p in pieces)
            assert [a for a, _ in ends] == [0, *[b for _, b in ends[:-1]]]
    return sum(r["length"] for r in rows) / (1024 * len(seqs))


def test_round_trip(spark):
    docs = table(spark, SF, "documents")
    texts = {r["doc_id"]: [r["text"]] for r in docs.collect()}
    rows = packing.op1_packing(spark, SF).collect()
    assert check(rows, texts) > 0.97
    tails = [r for r in rows if r["length"] < 1024]
    assert len(tails) < 2.5 * len(texts)  # most tails are whole


def test_odd_documents(spark):
    texts = {}
    for d, t, *_ in odd_rows():
        texts.setdefault(d, []).append(t)
    check(packing.pack(odd(spark), packing.byte_bpe()).collect(), texts)
    with_ids = packing.pack(odd(spark), packing.byte_bpe(), with_ids=True).collect()
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in with_ids)
    assert packing.pack(empty(spark), packing.byte_bpe()).count() == 0


def test_ids_are_those_of_the_library():
    rng = np.random.default_rng(3)
    encode = packing.Encoder(packing.byte_bpe(), added=True)
    for _ in range(60):
        text = "".join(chr(c) for c in rng.choice([*range(32, 127), 10, 13, 9, 0xE9, 0x4E2D, 0x1F600, 0xA0, 0x2003, 0x301, 0], 200))
        assert [*encode(text), 0] == ids_of(text)
    for text in ("<|endoftext|> it's we'll", " " * 5000 + "a", "\n" * 300, "don't\t\tstop", "ab" * 20_000):
        assert [*encode(text), 0] == ids_of(text)


@pytest.mark.parametrize("k", [1, 2, 7])
def test_differencing_is_near_equal(k):
    rng = np.random.default_rng(k)
    sizes = rng.integers(1, 60, 40 * k).tolist()
    sums = np.bincount(packing.differencing(sizes, k), weights=sizes, minlength=k)
    assert sums.sum() == sum(sizes) and sums.max() - sums.min() <= 3


def test_windows_rise_when_capacity_is_exceeded():
    assert len(set(packing.windows_of([6, 6, 6], 10).tolist())) == 3
    assert len(set(packing.windows_of([5, 5, 5, 5], 10).tolist())) == 2
    assert packing.windows_of([], 10).tolist() == []
    assert [sum(packing.tail_pieces(n)) for n in range(70)] == list(range(70))
    cut = packing.cut_some([100] * 10, 0.2)
    assert [sum(c) for c in cut] == [100] * 10 and [len(c) for c in cut[2:]] == [1] * 8 and len(cut[0]) > 1


def test_another_splitting_goes_to_the_library(tmp_path):
    import json

    with open(packing.byte_bpe(), encoding="utf-8") as f:
        spec = json.load(f)
    spec["pre_tokenizer"] = {**spec["pre_tokenizer"], "add_prefix_space": True}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec))
    assert packing.Encoder(str(path), added=True)("word two") == tokenizers.Tokenizer.from_file(str(path)).encode("word two", add_special_tokens=False).ids
    assert packing.Encoder(packing.byte_bpe()).fast is not None
