"""Fixtures of the training-data operators: odd documents, and plain re-statements of what the operators must return."""

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, start long, mark long, size long, block long, n_removed long, predicted int, node long, id long"
EXTRA = (0.5, 1, 2, 3, 4, 5, 6, 7, 8)


def odd_rows():
    words = " ".join(f"w{i % 997}x{i % 13}" for i in range(20_000))
    texts = [
        (1, None, "en", "a"), (2, "", None, None), (3, " \t\n ", "en", "a"), (4, "one two three four five six seven", "en", "a"), (4, "one two three four five six seven", "en", "a"),
        (4, "another text of the same id", "fr", "b"), (None, "no id here at all, of nobody", "en", None), (None, None, None, None), (7, words, "en", "a"), (8, words, "en", "b"), (9, "x" * 50_000, "de", "b"),
        (10, "é中文😀   ok fin", "fr", "a"), (11, "123 456 !!", "en", "a"), (-5, "one two three four five six seven", "en", "c"), (12, "a\n\nb\n\n\n\nb", "en", "c"), (13, "word", "xx", "c"),
    ]
    return [(d, t, lang, s, len(t or ""), *EXTRA) for d, t, lang, s in texts]


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def split(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


SF = "/root/testdata/sf0.001"
