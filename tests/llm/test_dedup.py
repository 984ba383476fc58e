import hashlib
import random
from collections import Counter, defaultdict

import pytest
from helpers import SF, documents, empty, odd, odd_rows, split

from quern.llm import components, line_dedup, substring_dedup
from quern.llm import jaccard_join as J
from quern.llm.common import table


# --- Lines -------------------------------------------------------------------------------------------------------


def lines_left(rows, chars=line_dedup.CHARS):
    """rows: (doc_id, text) in order; text without the lines of later runs."""
    seen, out = set(), {}
    gone = defaultdict(set)
    for d, t in rows:
        lines = t.split("\n")
        for p in range(len(lines)):
            for run in (tuple(lines[p : p + k]) for k in (1, 2, 3) if p + k <= len(lines)):
                if len(run) == 3 or sum(map(len, run)) >= chars:
                    if run in seen:
                        gone[d] |= set(range(p, p + len(run)))
                    seen.add(run)
    for d, t in rows:
        lines = t.split("\n")
        out[d] = ("\n".join(x for i, x in enumerate(lines) if i not in gone[d]), len(lines), len(gone[d]))
    return out


def test_lines_query(spark):
    rows = sorted((x["doc_id"], x["text"] or "") for x in table(spark, SF, "documents").collect())
    got = {x["doc_id"]: (x["kept_sha256"], x["n_lines"], x["n_removed"]) for x in line_dedup.op6_line_dedup(spark, SF).collect()}
    assert got == {d: (hashlib.sha256(t.encode()).hexdigest(), a, b) for d, (t, a, b) in lines_left(rows).items()}


def test_lines_of_odd_documents(spark):
    out = line_dedup.dedup_lines(odd(spark)).collect()
    assert len(out) == len(odd_rows())
    by = {r["doc_id"]: r for r in out}
    assert by[1]["text"] is None and by[1]["n_lines"] == 1 and by[8]["text"] == "" and by[8]["n_removed"] == 1
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


# --- Substrings --------------------------------------------------------------------------------------------------


def words_left(rows, window=35):
    count = Counter()
    for _, t in rows:
        w = split(t)
        count.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for d, t in rows:
        w = split(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def substrings(df, **options):
    rows = substring_dedup.dedup_spans(df, **options).collect()
    for r in rows:
        assert sum(s["end"] - s["first"] for s in r["spans"]) == r["n_removed"] and r["kept_sha256"] == hashlib.sha256(r["kept"].encode()).hexdigest()
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in rows), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_substrings_against_brute_force(spark, seed):
    r = random.Random(seed)
    passages = [[f"p{i}q{r.randrange(99)}" for _ in range(r.randrange(5, 30))] for i in range(6)]
    texts = []
    for _ in range(80):
        words = []
        for _ in range(r.randrange(0, 8)):
            words += r.choice(passages) if r.random() < 0.5 else [f"u{r.randrange(10**6)}" for _ in range(r.randrange(1, 15))]
        texts.append(r.choice([" ", "\n", "\t \x0b"]).join(words))
    texts[3] = texts[4]
    texts[5] = "la " * 90
    want = words_left(list(enumerate(texts)), 12)
    for block in (500, 3000, 1 << 20):
        assert substrings(documents(spark, texts), window=12, gram=3, block=block) == want


def parsed(texts, block, known, window=12, gram=3):
    import pyarrow as pa

    from quern.llm.common import BASES, Rolling, WordHasher

    p = substring_dedup.Parser(pa.array(texts), window, gram, WordHasher(), [Rolling(BASES[1]), Rolling(BASES[0])])
    return p, p.factors(block, known) if known else None


def test_a_long_copy_is_one_factor():
    """A document that takes 200 words of another block from one place is parsed into one factor with that source."""
    words = [f"w{i}" for i in range(300)]
    reference, _ = parsed([" ".join(words)], 5, None)
    at, anchor, key, length = reference.phrases()
    known = (anchor, key, substring_dedup.places(5, at))
    _, (first, n, source) = parsed([" ".join([*(f"a{i}" for i in range(40)), *words[50:250], *(f"b{i}" for i in range(40))])], 6, known)
    assert len(first) == 1 and n[0] > 170 and source[0] >> 32 == 5
    assert (source[0] & 0xFFFFFFFF) - 50 == first[0] - 40  # source and copy are in step
    _, (first, n, source) = parsed([" ".join([*words[20:120], *words[200:280]])], 6, known)
    assert len(first) == 2 and min(n) > 50
    _, (first, _, _) = parsed([" ".join(words)], 5, known)
    assert not len(first)  # a first place is no one's copy


def test_substrings_query(spark):
    rows = [(x["doc_id"], x["text"]) for x in table(spark, SF, "documents").collect()]
    got = {tuple(x) for x in substring_dedup.op9_substring_dedup(spark, SF).collect()}
    assert got == {(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in words_left(rows)}


def test_substrings_of_odd_documents(spark):
    assert substrings(odd(spark)) == words_left([(d, t) for d, t, *_ in odd_rows()])
    assert substrings(empty(spark)) == []
    same = documents(spark, [" ".join(f"w{i}" for i in range(40))] * 2, [1, 1])
    assert {n for _, _, n, _ in substrings(same)} == {40}


# --- Near-duplicates ---------------------------------------------------------------------------------------------


def similar(rows):
    """[(doc_id, class_id, copies, links)]; ids are unique."""
    sets = {}
    for d, t in rows:
        w = split(t)
        if w:
            sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    reps = defaultdict(list)
    for d, s in sets.items():
        reps[s].append(d)
    first = {s: min(x) for s, x in reps.items()}
    root = {d: d for d in first.values()}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    links, each = Counter(), list(first.items())
    for i, (s, a) in enumerate(each):
        for t, b in each[i + 1 :]:
            both = len(s & t)
            if both and 5 * both >= 4 * (len(s) + len(t) - both):
                links[a] += 1
                links[b] += 1
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return sorted((d, top(first[sets[d]]), len(reps[sets[d]]), links[first[sets[d]]]) if d in sets else (d, d, 1, 0) for d, _ in rows)


def near_texts(seed, n=120):
    r = random.Random(seed)
    texts = []
    for _ in range(n):
        if texts and r.random() < 0.6:
            w = split(r.choice(texts))
            for _ in range(r.randrange(0, 4)):
                if w:
                    w[r.randrange(len(w))] = f"e{r.randrange(999)}"
            texts.append(" ".join(w))
        else:
            texts.append(" ".join(f"t{r.randrange(10**5)}" for _ in range(r.choice([0, 1, 4, 5, 9, 60, 150]))))
    return texts


def got(df, **options):
    return sorted((r["doc_id"], r["class_id"], r["copies"], r["links"]) for r in J.similar(df, **options).collect())


def test_near_duplicates_against_brute_force(spark):
    texts = near_texts(1)
    assert got(documents(spark, texts)) == similar(list(enumerate(texts)))


def test_large_components_are_split_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "LARGE", 6)
    monkeypatch.setattr(J, "BLOCK", 3)
    texts = near_texts(2, 60)
    assert got(documents(spark, texts)) == similar(list(enumerate(texts)))


def test_components_of_many_blocks_meet_by_band(spark, monkeypatch):
    for name, value in (("LARGE", 4), ("BLOCK", 3), ("MOST_BLOCKS", 2)):
        monkeypatch.setattr(J, name, value)
    texts = near_texts(4, 80)
    assert got(documents(spark, texts)) == similar(list(enumerate(texts)))


def test_the_exact_way_needs_no_band(spark):
    texts = near_texts(3)
    assert got(documents(spark, texts), exact=True) == similar(list(enumerate(texts)))
    r = random.Random(8)
    for _ in range(300):  # any two sets of the threshold share a shingle of their prefixes
        whole = {r.randrange(10**9) for _ in range(r.randrange(1, 60))}
        a, b = (sorted(x for x in whole if r.random() > 0.1) for _ in range(2))
        if a and b and 5 * len(set(a) & set(b)) >= 4 * len(set(a) | set(b)):
            x, y = J.prefixes([J.np.array(a, J.np.uint64), J.np.array(b, J.np.uint64)])
            assert set(x.tolist()) & set(y.tolist())


def test_near_duplicates_query(spark):
    rows = [(x["doc_id"], x["text"]) for x in table(spark, SF, "documents").collect()]
    assert sorted(map(tuple, J.op10_jaccard_join(spark, SF).collect())) == similar(rows)


def test_near_duplicates_of_odd_documents(spark):
    assert J.similar(odd(spark)).count() == len(odd_rows())
    left = J.one_of_each(odd(spark))
    assert left.columns == odd(spark).columns
    kept = sorted((r["doc_id"] if r["doc_id"] is not None else -99, r["text"] or "") for r in left.collect())
    assert [d for d, t in kept if t.startswith("one two")] == [-5] and [d for d, t in kept if len(t) > 60_000] == [7]
    assert {d for d, t in kept if not split(t)} == {-99, 1, 2, 3}
    assert J.similar(empty(spark)).count() == 0 and J.one_of_each(empty(spark)).count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    for n in range(J.STEP, J.BANDS * J.ROWS + 1, J.STEP):
        m = J.least_matches(n)
        assert 0 < m < 0.8 * n
    assert J.least_matches(20, 0.8, 0.5) > J.least_matches(20, 0.8, 1e-6)


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(r.randrange(60), r.randrange(60)) for _ in range(30)] + [(7, 7)]
    root = {x: x for e in edges for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    alone = {x for x in root if all(x not in e for e in edges if e[0] != e[1])}
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: top(x) for x in root if x not in alone}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_words_do_not_depend_on_the_step(monkeypatch):
    from quern.llm import common

    r = random.Random(9)
    texts = ["", " ", "one", "é word  two\tthree", "x" * 700, *(" ".join("w" * r.randrange(1, 40) for _ in range(r.randrange(30))) for _ in range(40)), "end"]
    raw = [t.encode() for t in texts]
    data, off = J.np.frombuffer(b"".join(raw), J.np.uint8), J.np.cumsum([0, *map(len, raw)])
    one, two, first = common.WordHasher()(data, off)
    assert J.np.diff(first).tolist() == [len(split(t)) for t in texts]
    for step in (16, 50, 333):
        monkeypatch.setattr(common.WordHasher, "STEP", step)
        a, b, c = common.WordHasher()(data, off)
        assert (a == one).all() and (b == two).all() and (c == first).all()
    single = {w: h for t, s in zip(texts, first, strict=False) for w, h in zip(split(t), one[s:].tolist(), strict=False)}
    again, _, _ = common.WordHasher()(J.np.frombuffer("é two".encode(), J.np.uint8), J.np.array([0, 6]))
    assert again.tolist() == [single["é"], single["two"]]
