import zlib

import numpy as np
from helpers import SF, empty, odd

from quern.llm import langid, quality
from quern.llm.common import table


def test_languages_of_held_out_documents(spark):
    truth = {r["doc_id"]: r["lang"] for r in table(spark, SF, "documents").collect()}
    rows = langid.op3_language(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == set(truth) and len(rows) == len(truth)
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_documents(spark):
    model = langid.train(table(spark, SF, "documents"))
    rows = langid.predict(odd(spark), model).collect()
    assert len(rows) == odd(spark).count()
    und = [r for r in rows if r["lang_pred"] == "und"]
    assert {r["doc_id"] for r in und} == {1, 2, 3, 11, None} and all(r["score"] == 0 and r["rejected"] for r in und)
    assert langid.predict(empty(spark), model).count() == 0
    assert langid.train(empty(spark)) is None
    assert {r["lang_pred"] for r in langid.predict(odd(spark), None).collect()} == {"und"}
    assert langid.train(odd(spark)) is not None


def test_held_out_labels_teach_nothing(spark):
    docs = table(spark, SF, "documents").filter("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1")
    assert langid.train(docs) is None
    labels = table(spark, SF, "labels").join(docs, "doc_id", "left_semi")
    assert not quality.train(docs, labels).weights.any()


def test_scores_do_not_depend_on_neighbours(spark):
    model = langid.train(table(spark, SF, "documents"))
    texts = [r["text"] for r in table(spark, SF, "documents").limit(20).collect()]
    alone = np.concatenate([model.probabilities([t]) for t in texts])
    assert np.allclose(alone, model.probabilities(texts), atol=1e-5)


def test_quality_of_held_out_documents(spark):
    sf = SF.replace("0.001", "0.01")
    truth = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels").collect()}
    rows = quality.op7_quality(spark, sf).collect()
    assert len(rows) == table(spark, sf, "documents").count()
    held = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([p == t for p, t in held]) > 0.95
    assert all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)


def test_quality_of_odd_documents(spark):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (7, 1, 0), (11, 0, 0), (12, None, 1), (None, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(odd(spark), labels)
    out = quality.predict(odd(spark), model)
    assert out.count() == odd(spark).count() and set(out.columns) == set(odd(spark).columns)
    none = quality.train(empty(spark), labels.limit(0))
    assert {r["score"] for r in quality.predict_ids(odd(spark), none).collect()} == {0.5}
    assert quality.predict(empty(spark), model).count() == 0
    g = quality.Grams()
    one = b"Un un un. un. new"
    both = np.frombuffer(one + one, np.uint8)
    s = model.scores(both, np.array([0, len(one), len(both)]), g)
    assert s[0] == s[1]


def test_equal_neighbours_share_a_bucket():
    g = quality.Grams()
    key = lambda t: g(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[1].tolist()
    assert key(b"aa aa b")[0] == key(b"cc cc d")[0] and key(b"aa, aa, b")[0] == key(b"cc, cc, d")[0] and key(b"aa bb")[0] != key(b"cc dd")[0]


def test_language_scores_against_a_plain_loop(spark):
    """softmax of the bias and of the mean, over all grams of the lower-cased bytes and four spaces, of the buckets' weights."""
    model = langid.train(table(spark, SF, "documents"))
    for text in ("Ein Haus, zwei", "é中文😀 ok", "a"):
        raw = text.lower().encode() + b"    "
        total, n = np.zeros(len(model.languages)), 0
        for start in range(len(text.lower().encode())):
            for size in langid.NGRAMS:
                value = int.from_bytes(raw[start : start + size], "big")
                h = (value * 0x9E3779B1 + (size - 1) * 0x85EBCA6B) & 0xFFFFFFFF
                total += model.table[(h >> 16) & (langid.BUCKETS - 1)]
                n += 1
        e = np.exp(total / n + model.bias)
        assert np.allclose(model.probabilities([text])[0], e / e.sum(), atol=1e-5)


def test_many_labels_are_all_learned(spark):
    """No language is left out, however many there are; beyond the dimensions, embeddings are kept instead of logits."""
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}x " * 30, f"l{i % 300:03d}") for i in range(2400)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 300 and model.table.shape[1] == langid.DIM
    assert np.allclose(model.probabilities(["abc"]).sum(), 1)


def test_long_texts_are_taken_in_pieces(spark):
    model = langid.train(table(spark, SF, "documents"))
    text = " ".join(r["text"] for r in table(spark, SF, "documents").limit(40).collect() if r["text"]) + "é" * 500
    data = np.frombuffer(text.encode(), np.uint8)
    assert "".join(langid.pieces(data, 97)) == text
    for size in (64, 1000, 1 << 20):
        assert np.allclose(model.of_long(data, size), model.probabilities([text]), atol=1e-5)
    learned = quality.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    g = quality.Grams()
    words = np.frombuffer((text[:-500] + " again again, again end.").encode(), np.uint8)
    one, two, _ = g(words, np.array([0, len(words)]))
    for size in (600, 5000, 1 << 20):
        parts = list(g.long(words, size))
        assert np.concatenate([p[0] for p in parts]).tolist() == one.tolist() and np.concatenate([p[1] for p in parts]).tolist() == two.tolist()
        assert np.allclose(learned.of_long(words, g, size), learned.scores(words, np.array([0, len(words)]), g))
    assert sum(len(p[0]) for p in g.long(np.frombuffer(b"x" * 1000, np.uint8), 100)) == 10
    big = spark.createDataFrame([(1, text * (1 + (3 << 20) // len(text)), "en"), (2, text, "en")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(big, model).collect()}
    assert got[1][0] == got[2][0] and abs(got[1][1] - got[2][1]) < 0.01
    assert quality.predict_ids(big, learned).count() == 2


def test_quality_scores_against_a_plain_loop(spark):
    """The weights of all words and pairs of neighbours, over the root of the number of words, and the bias."""
    model = quality.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    g = quality.Grams()
    one_hash = lambda w: int(quality.word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]), g.roll)[0])
    mix = lambda x: int(quality.mix64(np.array([x & (2**64 - 1)], np.uint64))[0])
    text = [b"plain", b"words", b"words", b",", b"words", b"end"]
    h = [one_hash(w) for w in text]
    pairs = [mix(a * 3 + b) for a, b in zip(h[:-1], h[1:], strict=True)] + [mix(h[-1] * 3 + 1)]
    pairs[1], pairs[2] = int(quality._AGAIN[0]), int(quality._AGAIN[1])  # words words; words , words
    total = sum(float(model.weights[x >> (64 - quality.BITS)]) for x in h + pairs)
    want = 1 / (1 + np.exp(-(total / len(text) ** 0.5 + model.bias)))
    data = np.frombuffer(b"plain words words, words end", np.uint8)
    assert np.allclose(model.scores(data, np.array([0, len(data)]), g), want, atol=1e-6)


def test_rows_of_one_id_do_not_swamp_the_sample(spark):
    rows = [(5, f"text number {i % 700} of one id", "en") for i in range(1500)] + [(i, f"other {i}", "fr") for i in range(1000, 1100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(5, 1), *((i, 0) for i in range(1000, 1100))], "doc_id long, quality int")
    assert quality.sample(docs, labels, 100).count() < 300
    assert langid.sample(docs, 50).count() < 200
