from collections import Counter, defaultdict

import numpy as np
from helpers import SF, documents, empty, odd, odd_rows, split

from quern.llm import mixing
from quern.llm.common import table


def shared_out(sizes):
    """The rule of the targets, step by step. sizes: by source, in order."""
    weight = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    total, full = 1.5 * sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in full]
        rest = total - sum(2 * sizes[i] for i in full)
        out = [2.0 * sizes[i] if i in full else rest * weight[i] / sum(weight[j] for j in free) for i in range(len(sizes))]
        over = [i for i in free if out[i] > 2 * sizes[i] + 1e-9]
        if not over:
            return out
        full |= set(over)


def by_source(rows, source):
    out = defaultdict(list)
    for r in rows:
        out[source[r["doc_id"]]].append(r)
    return [out[k] for k in sorted(out, key=lambda s: (s is None, s or ""))]


def check(rows, texts, source):
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((d, len(split(t))) for d, t in texts)
    groups = by_source(rows, source)
    want = shared_out([sum(r["size"] for r in g) for g in groups])
    for g, target in zip(groups, want, strict=True):
        assert {r["source_size"] for r in g} == {sum(r["size"] for r in g)}
        assert np.allclose([r["target"] for r in g], target)
        assert abs(sum(r["taken"] for r in g) - target) <= 0.5  # to the word
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in g)


def test_query(spark):
    docs = table(spark, SF, "documents").collect()
    rows = mixing.op5_mixing(spark, SF).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in docs], {r["doc_id"]: r["source"] for r in docs})
    assert all(sum(x["words"] for x in r["shards"]) == r["taken"] for r in rows)
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.op5_mixing(spark, SF).collect()))


def test_targets_stop_at_twice_the_size(spark):
    for sizes in ([1000, 10, 10, 500, 0, 3], [5], [0, 0], [7, 7, 7], [100, 1, 100, 1, 100, 1]):
        df = spark.createDataFrame([(i, 0, f"s{i}", n) for i, n in enumerate(sizes)], "doc_id long, mark long, source string, size long")
        got = [r["target"] for r in sorted(mixing.targets(df).collect(), key=lambda r: r["src"])]
        assert np.allclose(got, shared_out(sizes))


def test_permutation(spark):
    n = 1000
    df = spark.range(n).select(mixing.permuted(mixing.F.col("id"), mixing.F.lit(n), mixing.F.lit(5).cast("long")).alias("x"))
    x = [r["x"] for r in df.collect()]
    assert sorted(x) == list(range(n)) and sum(a == i for i, a in enumerate(x)) < 20 and abs(np.corrcoef(x, range(n))[0, 1]) < 0.1


def test_shards_hold_every_part_once(spark):
    docs = documents(spark, [" ".join(f"w{i}" for i in range(50 * k)) for k in range(1, 12)])
    documents_, parts = mixing.mixture(mixing.measured(docs))
    seen = Counter()
    for r in parts.collect():
        for w in range(r["first"], r["first"] + r["words"]):
            seen[r["pass"], r["src"], r["start"], w] += 1
    assert max(seen.values()) == 1 and {k[0] for k in seen} <= {0, 1}
    assert sum(r["words"] for r in mixing.counts(parts).collect()) == sum(seen.values())


def test_mixed_texts(spark):
    docs = documents(spark, [" ".join(f"w{k}x{i}" for i in range(100 * k)) for k in range(1, 7)])
    sizes = mixing.measured(docs)
    taken = Counter()
    documents_, parts = mixing.mixture(sizes)
    at = {(r["src"], r["start"]): r["doc_id"] for r in documents_.filter("size > 0").collect()}
    for r in parts.collect():
        taken[at[r["src"], r["start"]]] += r["words"]
    out = Counter()
    texts = {r["doc_id"]: split(r["text"]) for r in docs.collect()}
    for r in mixing.mixed_texts(docs, sizes).collect():
        words = split(r["text"])
        out[r["doc_id"]] += len(words)
        it = iter(texts[r["doc_id"]])
        assert all(w in it for w in words)  # in order
    assert out == taken


def test_odd_documents(spark):
    rows = mixing.mixture(mixing.measured(odd(spark)))
    assert rows[0].count() == len(odd_rows())
    assert mixing.mixed_texts(odd(spark), mixing.measured(odd(spark))).columns == odd(spark).columns
    assert mixing.mixture(mixing.measured(empty(spark)))[1].count() == 0
    assert mixing.mixed_texts(empty(spark), mixing.measured(empty(spark))).count() == 0


def test_small_sources_meet_their_targets(spark):
    texts, source = [], {}
    for i, n in enumerate((10, 7, 40, 3, 33, 5000, 1)):
        texts.append((i, " ".join(f"w{k}" for k in range(n)), "en", f"s{i}", 0))
        source[i] = f"s{i}"
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long")
    documents_, parts = mixing.mixture(mixing.measured(docs))
    taken = Counter()
    for r in parts.collect():
        taken[r["src"]] += r["words"]
    for r in documents_.select("src", "target").distinct().collect():
        assert abs(taken[r["src"]] - r["target"]) <= 0.5


def test_shards_draw_their_counts(spark):
    """Counts of shards scatter as a multinomial draw's do, and shards are of nearly one size."""
    source = spark.createDataFrame([(0, 60_000), (1, 30_000), (2, 10_000), (3, 0)], "src int, slots long")
    n = {(r["shard"], r["src"]): r["n"] for r in mixing.drawn(spark, source, 7).collect()}
    size = Counter()
    for (shard, _), k in n.items():
        size[shard] += k
    assert set(size.values()) == {mixing.SHARD, 100_000 % mixing.SHARD} and sum(size.values()) == 100_000
    for src, share in ((0, 0.6), (1, 0.3), (2, 0.1)):
        z = [(n[s, src] - mixing.SHARD * share) / (mixing.SHARD * share * (1 - share)) ** 0.5 for s in range(24)]
        assert 0.5 < np.std(z) < 1.6 and abs(np.mean(z)) < 1
    assert mixing.drawn(spark, source.filter("src = 3"), 7).count() == 0


def test_running_sums_go_over_groups(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SPAN", 3)
    df = spark.createDataFrame([(b, i, i * i) for b in (0, 1) for i in range(0, 20, b + 1)], "src int, shard long, n long")
    for r in mixing.running(df, "src", "shard", "n", "before").collect():
        assert r["before"] == sum(i * i for i in range(0, r["shard"], r["src"] + 1))


def test_repeated_rows_are_numbered_one_after_another(spark):
    docs = documents(spark, ["a b c"] * 50 + ["d e"] * 3, [1] * 50 + [2, 2, 3])
    documents_, parts = mixing.mixture(mixing.measured(docs))
    places = Counter()
    for r in documents_.collect():
        places.update((r["src"], w) for w in range(r["start"], r["start"] + r["size"]))
    assert documents_.count() == 53 and max(places.values()) == 1
    seen = Counter()
    for r in parts.collect():
        seen.update((r["pass"], r["src"], r["start"] + w) for w in range(r["first"], r["first"] + r["words"]))
    assert max(seen.values()) == 1
