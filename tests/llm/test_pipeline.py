"""The pipeline's stages against plain re-statements of what each must do to its own input."""

import corpus_pipeline
from helpers import SF, empty, odd, split
from test_dedup import lines_left, similar
from test_packing import check

from quern.llm import mixing
from quern.llm.common import saved, table


def test_stages(spark):
    docs = table(spark, SF, "documents")
    names = docs.columns
    sets = [docs]
    for name, stage in corpus_pipeline.STAGES:
        sets.append(saved(stage(spark, sets[-1], SF), f"test-{name}"))
    texts = [[(r["doc_id"], r["text"]) for r in s.collect()] for s in sets[:5]]
    assert all(s.columns == names for s in sets[:5])
    assert set(texts[1]) <= set(texts[0]) and len(texts[1]) > 0.7 * len(texts[0])
    bad = {r["doc_id"] for r in table(spark, SF, "labels").filter("quality = 1").collect()} - {d for d, _ in texts[1]}
    assert not bad  # clean documents stay
    want = {d: t for d, (t, _, n) in lines_left(sorted((d, t or "") for d, t in texts[1])).items() if not n or split(t)}
    assert {d: t or "" for d, t in texts[2]} == want
    first = {d for d, c, _, _ in similar(texts[2]) if c == d}
    assert sorted(texts[3]) == sorted((d, t) for d, t in texts[2] if d in first)
    mixed = {}
    for d, t in texts[4]:
        mixed[d] = mixed.get(d, 0) + len(split(t))
    documents, parts = mixing.mixture(mixing.measured(sets[3]))
    at = {(r["src"], r["start"]): r["doc_id"] for r in documents.filter("size > 0").collect()}
    taken = {}
    for r in parts.collect():
        taken[at[r["src"], r["start"]]] = taken.get(at[r["src"], r["start"]], 0) + r["words"]
    assert mixed == taken
    by = {}
    for d, t in texts[4]:
        by.setdefault(d, []).append(t)
    assert check(sets[5].collect(), by) > 0.95
    assert all(r["n_chars"] == len(r["text"] or "") for r in sets[4].collect())


def test_odd_and_empty_documents(spark):
    for docs in (odd(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = saved(stage(spark, docs, SF), "test-odd")
            assert out.columns == docs.columns
            docs = out
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).count()
