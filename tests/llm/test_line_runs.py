"""Line dedup against brute force over all runs of any length, and against its SQL."""

import random

import duckdb
import pytest
from helpers import SF, documents, empty, odd

from quern.llm import line_dedup


def runs_left(texts, chars):
    """Text without any later run, of whatever length, that has three lines or `chars` characters."""
    seen, gone, out = set(), [set() for _ in texts], []
    split = [t.split("\n") for t in texts]
    for d, lines in enumerate(split):
        for p in range(len(lines)):
            for e in range(p + 1, len(lines) + 1):
                run = tuple(lines[p:e])
                if len(run) >= 3 or sum(map(len, run)) >= chars:
                    if run in seen:
                        gone[d] |= set(range(p, e))
                    seen.add(run)
        out.append(("\n".join(x for i, x in enumerate(lines) if i not in gone[d]), len(lines), len(gone[d])))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_runs_against_brute_force(spark, seed):
    r = random.Random(seed)
    texts = ["\n".join(r.choice(["a", "b", "", "x" * 4, "y" * 5, "z" * 8, *(f"u{r.randrange(99)}" for _ in range(9))]) for _ in range(r.randrange(1, 12))) for _ in range(60)]
    rows = line_dedup.dedup_lines(documents(spark, texts), chars=8).collect()
    assert [(x["text"], x["n_lines"], x["n_removed"]) for x in sorted(rows, key=lambda x: x["doc_id"])] == runs_left(texts, 8)


def test_short_repeats_go(spark):
    line, pair = "a line of fifty-two characters that stands elsewhere", "first part of it\nand the second part"
    docs = documents(spark, [f"{line}\none\n{pair}\nx", f"two\n{line}\nthree\n{pair}\nfour\nx"])
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs, chars=line_dedup.CHARS).collect()}[1] == "two\nthree\nfour\nx"


def test_query_against_its_sql(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = c.sql(line_dedup.OP6_SQL).fetchall()
    got = [tuple(r) for r in line_dedup.op6_line_dedup(spark, SF).collect()]
    assert sorted(got) == sorted(want)


def test_odd_documents(spark):
    assert line_dedup.dedup_lines(odd(spark), chars=8).count() == odd(spark).count()
    assert line_dedup.dedup_lines(empty(spark), chars=8).count() == 0


def test_positions_are_selected_once_and_thinned(spark):
    short = documents(spark, ["\n".join(f"{i}" for i in range(300))])
    rows = line_dedup.fingerprints(short).collect()
    assert 120 < len(rows) < 180  # about every second of 300 short lines, with three-line windows
    assert sum(len(r["runs"]) for r in rows) == 298 and len({r["fp"] for r in rows}) == len(rows)


def test_hot_lines_are_not_dealt_by_key(spark, monkeypatch):
    r = random.Random(5)
    texts = ["\n".join([f"unique line {i} of this text, once only", "the same line in every text there is", *([f"pair {i % 5}", "of lines in many texts"] * r.randrange(3))]) for i in range(90)]
    want = runs_left(texts, line_dedup.CHARS)
    for hot in (1000, 20, 2):
        monkeypatch.setattr(line_dedup, "HOT", hot)
        rows = line_dedup.dedup_lines(documents(spark, texts)).collect()
        assert [(x["text"], x["n_lines"], x["n_removed"]) for x in sorted(rows, key=lambda x: x["doc_id"])] == want
