import hashlib
import re

import pytest
from helpers import SF, documents, empty, odd

from quern.llm import secret_scan as S
from quern.llm.common import table

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]


@pytest.fixture(scope="module")
def model(spark):
    return S.train(S.labelled(table(spark, SF, "documents")).unionByName(S.synthetic(spark)))


def test_query_against_plain_patterns(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, SF, "documents").collect()}
    rows = S.op4_secrets(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex"))
        assert set(want) <= set(r["spans"].split(",")) | {""}


CASES = [
    "", "token=", "é😀 Password = 'abcdefghijkl' x", "token: secret=abcdefghijklmn", "password = token: abcdefghijklmnop", "AKIA" + "A" * 13, "AKIA" + "A" * 14, "xAKIAAKIA" + "B" * 20,
    "0123456789abcdef", "0123456789abcde", "Z0123456789abcdef0G", "api_key:'0123456789abcdef' apikey=shortone123", "PASSWD\"='q.w+e/r_t=y-u123'", "token=" + "a" * 11 + " token=" + "a" * 12, "Key toKen=abcdefghijklmn",
]


def test_base_patterns_on_odd_texts(spark):
    rows = S.scan(documents(spark, CASES)).select("doc_id", S.listed(S.F.col("base")).alias("b")).collect()
    assert {r["doc_id"]: r["b"] for r in rows} == {i: ",".join(base(t)) for i, t in enumerate(CASES)}


def test_markov_finds_what_no_pattern_knows(spark, model):
    secret = "q7Zp0XvT3mKd9RfYw2LhB6sNjC4g"
    texts = [f"é see {secret} here", "an internationalization_of_the_documents here", "the thintionblehaingthereshandthat of the", f"token={secret}"]
    rows = {r["doc_id"]: r["s"] for r in S.scan(documents(spark, texts), model).select("doc_id", S.listed(S.F.col("spans")).alias("s")).collect()}
    assert rows[0] == f"markov:6:{6 + len(secret)}" and rows[1] == "" and rows[2] == "" and rows[3] == f"assign:0:{6 + len(secret)}"


def test_odd_documents(spark, model):
    assert S.scan(odd(spark), model).count() == odd(spark).count()
    assert S.scan(empty(spark), model).count() == 0
    none = S.train(S.labelled(empty(spark)))
    assert S.scan(odd(spark), none).count() == odd(spark).count()


def test_positions_over_many_strides(spark):
    text = " é ".join(f"token={'x' * 12}{i} {'0123456789abcdef' * (1 + i % 3)} AKIA{'Z' * 14}{i}" for i in range(500))
    got = S.scan(documents(spark, [text, "0123456789abcdef " * 64, ""])).select("doc_id", S.listed(S.F.col("base")).alias("b")).collect()
    assert {r["doc_id"]: r["b"] for r in got} == {0: ",".join(base(text)), 1: ",".join(base("0123456789abcdef " * 64)), 2: ""}


def test_time_is_in_proportion_to_matches(spark, model):
    import time

    took = []
    for n in (4_000, 4_000, 32_000):  # the first warms up
        text = "".join(f"{i:016x} q7Zp0XvT3mKd9RfYw2LhB6sNjC4g " for i in range(n))
        start = time.time()
        found = S.scan(documents(spark, [text]), model).select(S.F.size("base").alias("b"), S.F.size("spans").alias("s")).collect()[0]
        took.append(time.time() - start)
        assert (found["b"], found["s"]) == (n, 2 * n)
    assert took[2] < 24 * took[1]


def test_added_spans_against_plain_rules(spark, model):
    """Tokens of what the base leaves, judged whole or, failing that, by their parts, with the model's ratios summed in a plain loop."""
    size, place = len(S.ALPHABET), {c: i for i, c in enumerate(S.ALPHABET)}

    def random(v):
        pairs = [(a, b) for a, b in zip(v[:-1], v[1:]) if a in place and b in place]
        return bool(pairs) and sum(round(model.ratios[place[a] * size + place[b]], 6) for a, b in pairs) / len(pairs) > model.threshold

    def mask(text, spans):
        return "".join(S.MASK if any(a <= i < e for a, e in spans) else c for i, c in enumerate(text))

    def added(text):
        taken = [tuple(map(int, s.split(":")[1:])) for s in base(text)]
        left, out = mask(text, taken), []
        for m in re.finditer(f"[A-Za-z0-9+/_={S.MASK}-]{{{S.LEAST},}}", left):
            if S.MASK not in m[0] and random(m[0]):
                out.append((m.start(), m.end()))
                continue
            value = m[0]
            for p in S.PARTS:
                hits = [(h.start(), h.end()) for h in re.finditer(p, value) if random(h[0])]
                out += [(m.start() + a, m.start() + e) for a, e in hits]
                value = mask(value, hits)
        return [f"markov:{a}:{e}" for a, e in out]

    key = "q7Zp0XvT3mKd9RfYw2LhB6sNjC4g"
    texts = [f"see {key} and /usr/share/{key}/lib_of-things", f"token={key}/{key} x", f"a0123456789abcdef{key}=", f"{key[:13]}/{key[:12]}_{key}-the-documentation", "nothing_of_interest/in-these-words"]
    texts += [r["text"] or "" for r in table(spark, SF, "documents").collect()]
    rows = S.scan(documents(spark, texts), model).select("doc_id", S.listed(S.F.filter("spans", lambda s: s["kind"] == 3)).alias("m")).collect()
    assert {r["doc_id"]: sorted(filter(None, r["m"].split(","))) for r in rows} == {i: sorted(added(t)) for i, t in enumerate(texts)}


def test_other_signs_end_a_token(spark, model):
    key = "q7Zp0XvT3mKd9RfYw2LhB6sNjC4g"
    texts = [f"<{key}>", f"é?{key}[0]é", f"{key}@中"]
    rows = S.scan(documents(spark, texts), model).select("doc_id", S.listed(S.F.col("spans")).alias("s")).collect()
    assert {r["doc_id"]: r["s"] for r in rows} == {i: f"markov:{t.index(key)}:{t.index(key) + len(key)}" for i, t in enumerate(texts)}
