import hashlib

import numpy as np
from helpers import SF, documents, empty, odd, odd_rows

from quern.llm import fingerprint as fp
from quern.llm.common import table


def code(text):
    """A digest, in plain loops."""
    raw, counts = text.encode(), [0] * 256
    for a, b, c in zip(raw, raw[1:], raw[2:]):
        counts[((a << 16 | b << 8 | c) * 0x9E3779B1 & 0xFFFFFFFF) >> 24] += 1
    ranked = sorted(counts)
    codes = [sum(c > ranked[q] for q in (63, 127, 191)) for c in counts]
    packed = bytes(codes[i] << 6 | codes[i + 1] << 4 | codes[i + 2] << 2 | codes[i + 3] for i in range(0, 256, 4))
    return f"{min(255, round(12 * np.log1p(len(raw)))):02x}{packed.hex()}"


def near(a, b):
    x, y = (fp.decoded([d]) for d in (a, b))
    apart = sum([0, 1, 2, 6][abs(int(i) - int(j))] for i, j in zip(x[0][0], y[0][0])) + abs(int(x[1][0]) - int(y[1][0]))
    return 1 - min(apart, fp.BOUND) / fp.BOUND


def expected(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for (i, t), (_, o) in zip(order, order[1:] + order[:1]):
        cut = len(t) // 3
        e = t[: len(t) - cut] + o[:cut]
        out[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), code(t), code(e), near(code(t), code(e)), near(code(t), code(o)))
    return out


def test_query_against_plain_loops(spark):
    for parts in (1, 5):
        rows = [(r["doc_id"], r["text"] or "") for r in table(spark, SF, "documents").collect()]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = {r["doc_id"]: tuple(r)[1:] for r in fp.edit_probe(df).collect()}
        want = expected(rows)
        assert got.keys() == want.keys()
        for i in got:
            assert got[i][:4] == want[i][:4] and np.allclose(got[i][4:], want[i][4:])
    assert np.mean([v[4] > v[5] for v in want.values()]) > 0.95


def test_odd_documents(spark):
    rows = fp.edit_probe(odd(spark)).collect()
    assert len(rows) == len(odd_rows())
    assert sorted(r["fingerprint"] for r in rows) == sorted(code(t or "") for _, t, *_ in odd_rows())
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert fp.edit_probe(empty(spark)).count() == 0
    assert fp.edit_probe(odd(spark).filter("doc_id = 10")).first()["near_next"] == 1
    assert sorted(r["fingerprint"] for r in fp.fingerprints(odd(spark)).collect()) == sorted(code(t or "") for _, t, *_ in odd_rows())


def test_round_trip_of_digests():
    a = fp.digests(*fp.joined(["hello world, hello", "", "ab", "é" * 99]))
    b = fp.decoded(fp.encoded(*a))
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all() and (fp.likeness(a, b) == 1).all()


def test_long_texts_are_counted_in_pieces(monkeypatch):
    data = np.frombuffer(bytes(range(256)) * 40, np.uint8)
    whole = fp._counts(np.concatenate([data, data[:0]]), np.array([0, len(data), len(data)]))[0]
    for piece in (7, 100, 1 << 20):
        monkeypatch.setattr(fp, "PIECE", piece)
        assert (fp._counts(data, np.array([0, len(data)]))[0] == whole).all()


def test_repeated_rows_over_several_ranges(spark):
    docs = documents(spark, ["same text of all"] * 200 + ["other"], [5] * 200 + [9]).repartition(4)
    rows = fp.edit_probe(docs).collect()
    assert len(rows) == 201 and len({tuple(r) for r in rows if r["doc_id"] == 5 and r["near_next"] == 1}) == 1
    assert sum(r["near_next"] == 1 for r in rows) == 199
