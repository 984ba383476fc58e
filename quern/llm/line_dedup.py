"""Line dedup by winnowing over line hashes.

A document is a sequence of lines; a run of lines counts as a repeat from three lines or from CHARS characters on. Windows
are the shortest such runs: one line, two or three. Of each window the line with the least hash is selected (the first among equals), and a position that several
windows select is one fingerprint: whatever run stands in two places has a window in both whose fingerprint is the same line. So
lines of prose each are a fingerprint, and of shorter lines about every second is.

Positions are joined by fingerprint: only those whose fingerprint occurs again are looked at further. A shared position is extended
both ways by the windows that selected it, compared by keys of two 64-bit hashes of their lines; the first place (by document, then line) of each window stays and all
later ones are deleted. As neighbouring windows overlap, a longer repeat is deleted as far as it reaches in either direction, whichever
places it was matched with.

A group of places is never paired with itself: its first place is a minimum, taken before any shuffle as far as possible, and every other place meets that one.
Fingerprints and windows that make up more than a thousandth of all are fewer than a thousand; their first places are broadcast and their rows are not
dealt by key. All is built from DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import drop_saved, saved, table

#: Lines of the longest window, and the characters from which one or two lines are a window.
RUN, CHARS = 3, 30
#: A key is hot from one row in so many on; there are fewer such keys than that.
HOT = 1000


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars: int = CHARS) -> DataFrame:
    """(id, mark, fp, runs): each selected line of each document once, with the windows (p, n, k1, k2) that selected it; mark is a hash of the text.

    A window is a line of `chars` characters or more, two lines that have so many in all but are not both such lines, or three lines
    of which not both pairs have so many: what is left out is covered by shorter windows.
    """
    lines = F.split(_text(text_col), "\n", -1)
    hashed = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(x, F.lit(1)).alias("b"), F.length(x).alias("size")))
    h = F.col("h")
    at = lambda i: F.get(h, i)  # noqa: E731  null beyond the text's ends, and so is every condition on it
    one = lambda i: at(i)["size"] >= chars
    two = lambda i: at(i)["size"] + at(i + 1)["size"] >= chars

    def window(p: Column, n: int, selected: Column) -> Column:
        part = lambda name: F.transform(F.slice(h, p + 1, F.lit(n)), lambda x: x[name])
        run = {1: one(p), 2: two(p) & ~(one(p) & one(p + 1)), 3: ~(two(p) & two(p + 1))}[n] & selected
        key = F.struct(p.alias("p"), F.lit(n).alias("n"), F.xxhash64(F.lit(n), part("a")).alias("k1"), F.xxhash64(part("b"), F.lit(n)).alias("k2"))
        return F.when(run, key)

    def windows(f: Column) -> Column:
        before = lambda k: at(f)["a"] < at(f - k)["a"]
        after = lambda k: at(f)["a"] <= at(f + k)["a"]
        every = [
            window(f, 1, F.lit(True)), window(f, 2, after(1)), window(f - 1, 2, before(1)),
            window(f, 3, after(1) & after(2)), window(f - 1, 3, before(1) & after(1)), window(f - 2, 3, before(2) & before(1)),
        ]
        return F.array_compact(F.array(*every))

    rows = docs.select(F.col(id_col), F.xxhash64(_text(text_col)).alias("mark"), hashed.alias("h"))
    marks = F.transform(F.sequence(F.lit(0), F.size("h") - 1), lambda f: F.struct(at(f)["a"].alias("fp"), windows(f).alias("runs")))
    return rows.select(id_col, "mark", F.explode(F.filter(marks, lambda m: F.size(m["runs"]) > 0)).alias("m")).select(id_col, "mark", "m.fp", "m.runs")


def met(rows: DataFrame, counted: DataFrame, keys: list[str], place: list[str]) -> DataFrame:
    """rows joined with counted (keys, c and other columns; c is how many rows have those keys) without dealing hot keys to one task.

    Keys with more than one in HOT of all the rows counted are fewer than HOT, which is the bound of what is broadcast; rows of these
    keys are then dealt by their place, with no partner left to meet.
    """
    total = counted.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    more = [c for c in counted.columns if c not in keys]
    hot = counted.filter(F.col("c") * HOT > total).select(*keys, *[F.col(c).alias(f"_hot_{c}") for c in more])
    cold = counted.filter(F.col("c") * HOT <= total).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.lit(False).alias("_is_hot"), *more)
    rows = rows.join(F.broadcast(hot), keys, "left").withColumn("_was_hot", F.col("_hot_c").isNotNull())
    dealt = [F.when(F.col("_was_hot"), F.xxhash64(*place)).otherwise(F.col(k)) if i == 0 else F.col(k) for i, k in enumerate(keys)]
    rows = rows.select("*", *[d.alias(f"_d{i}") for i, d in enumerate(dealt)])
    same = (F.col("_was_hot") == F.col("_is_hot"))
    for i in range(len(keys)):
        same &= F.col(f"_d{i}") == F.col(f"_k{i}")
    both = rows.join(cold, same, "left").filter("_was_hot OR c IS NOT NULL")
    mine = [c for c in rows.columns if not c.startswith("_")]
    return both.select(*mine, *[F.coalesce(f"_hot_{c}", c).alias(c) for c in more])


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars: int = CHARS) -> DataFrame:
    """(id, mark, gone): the numbers of the lines to delete from each document that has any."""
    marks = fingerprints(docs, id_col, text_col, chars).withColumnRenamed(id_col, "id")
    found = saved(marks, "fingerprints")
    shared = saved(found.groupBy("fp").agg(F.count("*").alias("c")).filter("c > 1"), "shared")
    runs = met(found, shared, ["fp"], ["id", "mark", "runs"]).select("id", "mark", F.explode("runs").alias("r")).select("id", "mark", "r.*")
    runs = saved(runs, "windows")
    drop_saved(found)
    drop_saved(shared)
    place = F.struct("id", "mark", "p")
    first = saved(runs.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.count("*").alias("c")).filter("c > 1"), "first")
    later = met(runs, first, ["k1", "k2"], ["id", "mark", "p"]).filter(~place.eqNullSafe(F.col("first")))
    line = F.explode(F.sequence(F.col("p"), F.col("p") + F.col("n") - 1))
    gone = later.select("id", "mark", line.alias("line")).groupBy("id", "mark").agg(F.collect_set("line").alias("gone"))
    return gone.withColumnRenamed("id", id_col)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars: int = CHARS, n_lines: str = "n_lines", n_removed: str = "n_removed") -> DataFrame:
    """docs with the text that remains, and n_lines and n_removed: a line is deleted where it belongs to a run of three lines, or of one or
    two lines of `chars` characters in all or more, that also stands in an earlier place.

    Earlier is by (id, hash of the text, line); a null id is before others. Rows equal in id and text are one document
    and share its result. A null text counts as one empty line, as does an empty one, and stays as it is. A document may lose all its
    lines, which leaves an empty text. A very long text is one array of lines. An empty table gives no rows. Other columns are kept, except that
    one with the name of a new column gives way to it.
    """
    docs = docs.drop(n_lines, n_removed)
    gone = repeated_lines(docs, id_col, text_col, chars).select(F.col(id_col).alias("_id"), F.col("mark").alias("_mark"), F.col("gone").alias("_gone"))
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(_text(text_col)) == F.col("_mark"))
    # hashed by partition: line numbers only, a small part of the texts that they meet, which then need no sort
    both = docs.join(gone.hint("shuffle_hash"), same, "left")
    lines = F.split(_text(text_col), "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone")
    both = both.withColumn("_lines", F.when(F.col("_gone").isNotNull(), lines))
    kept = F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("_lines"), i)), "\n"))
    n = F.when(F.col("_gone").isNull(), F.size(lines)).otherwise(F.size("_lines"))
    columns = [kept.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return both.select(*columns, n.cast("long").alias(n_lines), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias(n_removed))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(_text("text"), 256).alias("kept_sha256"))


OP6_SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents
), w AS (
  SELECT *, lead(line) OVER d AS b, lead(line, 2) OVER d AS c FROM l WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), later AS (
  SELECT doc_id, i, i + 2 AS e FROM w WHERE c IS NOT NULL QUALIFY row_number() OVER (PARTITION BY line, b, c ORDER BY doc_id, i) > 1
  UNION ALL
  SELECT doc_id, i, i + 1 FROM w WHERE length(line) + length(b) >= {CHARS} QUALIFY row_number() OVER (PARTITION BY line, b ORDER BY doc_id, i) > 1
  UNION ALL
  SELECT doc_id, i, i FROM w WHERE length(line) >= {CHARS} QUALIFY row_number() OVER (PARTITION BY line ORDER BY doc_id, i) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, e)) AS i FROM later
)
SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
"""
