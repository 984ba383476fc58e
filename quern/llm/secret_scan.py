"""Secret scans: base patterns, and character Markov models of random strings and ordinary identifiers.

Two bigram models over the characters of keys and identifiers are trained by counting labelled samples. A token's
log-likelihood ratio per character between them tells random strings from ordinary ones. All of it is built from DataFrame functions:
counts are aggregates, the ratio table is a literal array, and a token is scored by a fold over its characters.

Work is linear in a text and its matches: positions are running sums in two levels, and what a span has taken is masked before the next search,
so that spans are never compared with each other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import table

#: The base patterns, the least length of what they must hold, and their order among equal starts.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12
KINDS = ("assign", "access", "hex", "markov")

#: Tokens that the Markov models judge: so many characters of this alphabet at least, in one run.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LEAST = 12
TOKEN = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"
#: Parts of a token that are judged too: between / and =, between _ = and -, and between all four, so that a key is met alone behind a path or name.
PARTS = tuple(rf"[A-Za-z0-9+{more}]{{{LEAST},}}" for more in ("_-", "/", ""))
#: Labelled samples: the strings of about so many documents, and what is added to each count of a pair of characters.
SAMPLE, SMOOTH = 4000, 0.5
HINTED = 4


#: Stands for each character that a span has taken; matches whose positions are summed at a time.
MASK, STRIDE = "\ue000", 64


def _once(value: Column, use) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.get(F.transform(F.array(value), use), 0)


def _found(text: Column, pattern: str, keep) -> Column:
    """[(gap before, match, whether keep(match))] in order, with a last gap and no match."""
    both = _once(text, lambda t: F.arrays_zip(F.split(t, pattern, -1).alias("gap"), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("hit")))
    return F.transform(both, lambda x: F.struct(x["gap"].alias("gap"), x["hit"].alias("hit"), F.coalesce(x["hit"].isNotNull() & keep(x["hit"]), F.lit(False)).alias("ok")))


def _masked(found: Column) -> Column:
    """The text again, with the kept matches masked."""
    return F.array_join(F.transform(found, lambda x: F.concat(x["gap"], F.when(x["ok"], F.repeat(F.lit(MASK), F.length(x["hit"]))).otherwise(F.coalesce(x["hit"], F.lit(""))))), "")


def _spans(found: Column, kind: str) -> Column:
    """[(start, end, kind, value)] of the kept matches, in code points.

    A fold that appends copies what it has so far; so matches are taken STRIDE at a time, from the running sum of the strides before.
    """
    no = F.array().cast("array<struct<start:int,end:int,kind:int,value:string>>")
    width = lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        start, end = acc["at"] + F.length(x["gap"]), acc["at"] + width(x)
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(KINDS.index(kind)).alias("kind"), x["hit"].alias("value"))
        return F.struct(end.alias("at"), F.when(x["ok"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def placed(strides: Column) -> Column:
        sums = F.transform(strides, lambda s: F.aggregate(s, F.lit(0), lambda n, x: n + width(x)))
        return _once(F.aggregate(sums, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n))), lambda offsets: within(strides, offsets))

    def within(strides: Column, offsets: Column) -> Column:
        return F.flatten(F.transform(strides, lambda s, i: F.aggregate(s, F.struct(F.get(offsets, i).alias("at"), no.alias("out")), step, lambda acc: acc["out"])))

    def cut(f: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(f), F.lit(STRIDE))
        return _once(F.transform(starts, lambda i: F.slice(f, i, F.lit(STRIDE))), placed)

    return _once(found, cut)


def _yes(hit: Column) -> Column:
    return F.lit(True)


def _long(hit: Column) -> Column:
    return F.length(F.regexp_extract(hit, ASSIGN, 2)) >= ASSIGN_LEAST


def base_spans(text: Column) -> Column:
    """Spans of the base patterns, by kind and start."""
    return F.concat(_spans(_found(text, ASSIGN, _long), "assign"), _spans(_found(text, ACCESS, _yes), "access"), _spans(_found(text, HEX, _yes), "hex"))


def without_base(text: Column) -> Column:
    """The text with the base spans masked: assignments first, then access keys and hexadecimal runs in what is left."""
    return _masked(_found(_masked(_found(text, ASSIGN, _long)), f"{ACCESS}|{HEX}", _yes))


def labelled(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(secret, value): strings labelled by the base patterns as random, and by none of them as ordinary.

    Random: what an assignment holds (its longest run of the alphabet), access keys and hexadecimal runs. Ordinary: words and
    identifiers of 12 characters or more of the same documents, but for those that hold a digit beside a letter, which may be secrets that no
    pattern knows. Ordinary strings are of about `sample` documents chosen by a hash of their id, random ones of HINTED times as many.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lot = F.pmod(F.xxhash64(F.lit("secrets"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    n = max(1, docs.count())
    plain = docs.filter(lot < sample / n).select(F.explode(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9+/_=-]{12,}"), F.lit(0))).alias("value"))
    plain = plain.filter(~(F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")))
    known = docs.filter(lot < HINTED * sample / n).select(F.explode(base_spans(text)).alias("s"))
    value = F.when(F.col("s.kind") == 0, F.regexp_extract("s.value", ASSIGN, 2)).otherwise(F.col("s.value"))
    return known.select(F.lit(True).alias("secret"), value.alias("value")).unionByName(plain.select(F.lit(False).alias("secret"), "value"))


def synthetic(spark: SparkSession, n: int = 2000) -> DataFrame:
    """Random strings by rule, labelled as such: base64, base32-like and hexadecimal digits of hashes."""
    h = F.sha2(F.concat(F.lit("quern"), F.col("id").cast("string")), 256)
    kinds = [F.regexp_replace(F.base64(F.unhex(h)), "=", ""), F.upper(F.conv(F.substring(h, 1, 15), 16, 36)), h]
    return spark.range(n).select(F.lit(True).alias("secret"), F.explode(F.array(*kinds)).alias("value"))


class Markov:
    """The log-likelihood ratios of pairs of characters, and the ratio a token must exceed."""

    def __init__(self, ratios: list[float], threshold: float):
        self.ratios, self.threshold = ratios, threshold

    def score(self, token: Column) -> Column:
        """The mean log-likelihood ratio over the token's pairs of characters; null under two characters."""
        size = len(ALPHABET)
        ratios = F.expr("cast(split('" + ",".join(f"{r:.6f}" for r in self.ratios) + "', ',') as array<double>)")
        at = lambda c: F.instr(F.lit(ALPHABET), c) - 1
        start = F.struct(F.lit(-1).alias("before"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"))

        def step(acc: Column, c: Column) -> Column:
            here = at(c)
            both = (acc["before"] >= 0) & (here >= 0)
            more = F.when(both, F.get(ratios, acc["before"] * size + here)).otherwise(0.0)
            return F.struct(here.alias("before"), (acc["sum"] + more).alias("sum"), (acc["n"] + both.cast("int")).alias("n"))

        return F.aggregate(F.split(token, ""), start, step, lambda acc: F.when(acc["n"] > 0, acc["sum"] / acc["n"]))


def train(samples: DataFrame, smooth: float = SMOOTH) -> Markov:
    """Count pairs of neighbouring characters of the labelled (secret, value) rows; the counts are at most 2 x 68 x 68 rows.

    The threshold lies halfway between what random strings and ordinary ones are expected to score.
    """
    value = F.col("value")
    pairs = F.transform(F.sequence(F.lit(1), F.length(value) - 1), lambda i: F.substring(value, i, F.lit(2)))
    rows = samples.filter(F.length("value") > 1).select("secret", F.explode(pairs).alias("pair")).groupBy("secret", "pair").count()
    place = {c: i for i, c in enumerate(ALPHABET)}
    size = len(ALPHABET)
    counts = {True: [[smooth] * size for _ in range(size)], False: [[smooth] * size for _ in range(size)]}
    for r in rows.filter(F.col("pair").rlike(r"^[A-Za-z0-9+/_=-]{2}$")).collect():
        counts[r["secret"]][place[r["pair"][0]]][place[r["pair"][1]]] += r["count"]
    random, plain = ([[c / sum(row) for c in row] for row in counts[k]] for k in (True, False))
    ratios = [max(-4.0, min(4.0, math.log(a / b))) for x, y in zip(random, plain, strict=True) for a, b in zip(x, y, strict=True)]

    def expected(kind: bool) -> float:
        seen = [c - smooth for row in counts[kind] for c in row]
        return sum(c * r for c, r in zip(seen, ratios, strict=True)) / max(1, sum(seen))

    return Markov(ratios, max(0.0, (expected(True) + expected(False)) / 2))


def scan(docs: DataFrame, model: Markov | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' id with base and spans: arrays of (start, end, kind, value), by start and then kind.

    spans adds to the base the tokens, or parts of tokens, that the model takes for random, in what the base spans leave of a text. A null text
    is empty and has none; a null id is carried as it is. Repeated rows each give a row, an empty table none; other columns, whatever their names, are not carried. A score equal to
    the threshold is not random. Very long texts take time in proportion to their length and matches.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    none = F.array().cast("array<struct<start:int,end:int,kind:int,value:string>>")
    rows = docs.select(F.col(id_col), base_spans(text).alias("base"), (none if model is None else markov_tokens(without_base(text))).alias("tokens"))
    more = none if model is None else markov_spans(F.col("tokens"), model)
    rows = rows.select(id_col, "base", more.alias("more"))
    return rows.select(id_col, by_start(F.col("base")).alias("base"), by_start(F.concat("base", "more")).alias("spans"))


def markov_tokens(text: Column) -> Column:
    """Runs of the alphabet, and of masked characters, that hold LEAST unmasked ones in a row."""
    return _spans(_found(text, f"[A-Za-z0-9+/_={MASK}-]{{{LEAST},}}", lambda hit: hit.rlike(TOKEN)), "markov")


def markov_spans(tokens: Column, model: Markov) -> Column:
    """Spans of the tokens whose mean log-likelihood ratio exceeds the model's threshold, and of such parts of others.

    A token with masked characters is judged by its parts only. Parts are taken level by level, each in what those before it left.
    """
    none = F.array().cast("array<struct<start:int,end:int,kind:int,value:string>>")
    random = lambda v: F.coalesce(model.score(v), F.lit(-1.0)) > model.threshold

    def parts(value: Column, levels: tuple[str, ...]) -> Column:
        first, rest = levels[0], levels[1:]
        found = _found(value, first, random)
        return _once(found, lambda f: F.concat(_spans(f, "markov"), parts(_masked(f), rest)) if rest else _spans(f, "markov"))

    def judged(t: Column) -> Column:
        moved = lambda s: F.struct((s["start"] + t["start"]).alias("start"), (s["end"] + t["start"]).alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))
        whole = ~t["value"].contains(MASK)
        return F.when(whole & random(t["value"]), F.array(t)).when(~whole | t["value"].rlike("[/=_-]"), F.transform(parts(t["value"], PARTS), moved)).otherwise(none)

    return F.flatten(F.transform(tokens, judged))


def by_start(spans: Column) -> Column:
    return F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value"))))


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, train(labelled(docs).unionByName(synthetic(spark))))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
