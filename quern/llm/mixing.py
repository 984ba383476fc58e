"""Mixing sources to target weights by fixed-length blocks, drawn shard by shard.

The words of a source's documents, one document after another, are cut into blocks of equal length; what is left at a source's
end is one shorter block. The output is made of shards of equal numbers of slots. Each shard draws how many of its slots each source
gets: every slot falls on a source at random by the sources' shares, so that a shard's counts are a multinomial draw. The
draws of all shards are then reconciled with the targets: a source's running count over the shards is scaled by what it must have to what it drew, so that
its total is its target's while its shards keep the proportions of the draw. A shard's slots of a source are the
next places of that source's pseudorandom permutation of block numbers, another one for each pass over
the source; slots and blocks are joined by source and block number. A source's last slot takes only the words that its
target still lacks, so that the words taken are the target to the word.

All of it is DataFrame functions. Running sums go over groups of bounded size and then over the groups; rows that are equal are numbered as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.common import WORD, saved, table

#: Words of a block; slots of an output shard on average; rounds of the permutation.
BLOCK, SHARD, ROUNDS = 32, 4096, 8
#: Weights by a source's place, the share of all words that is mixed, and how often a word may be taken.
WEIGHTS, SHARE, REPEATS = (3, 1, 2), 1.5, 2
#: Documents of a source are numbered within buckets of about so many documents of the whole table.
BUCKET = 1024
#: Running sums are taken over so many neighbouring buckets or shards at a time.
SPAN = 4096


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, mark, source, size) of each row; mark is a hash of its text. Written to the shared folder: texts are read once."""
    return saved(docs.select("doc_id", F.xxhash64(text_col).alias("mark"), "source", words(F.col(text_col)).alias("size")), "sizes")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(src, source, source_size, target): one row for each source.

    Sources come by code point, null last, and src numbers them. Their targets are in proportion to their weights,
    except that none exceeds `repeats` times its source's size: where the excess has been reshared until none is
    above, the sources that stop there are those with the least size for their weight, and the others share the rest by weight.
    """
    every = Window.orderBy(F.asc_nulls_last("source"))  # one row for each source
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("src", F.row_number().over(every) - 1)
    s = s.withColumn("w", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("src") % len(weights)))
    s = s.withColumn("most", F.col("source_size") * float(repeats)).withColumn("level", F.col("most") / F.col("w"))
    up = Window.orderBy("level", "src").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("level", "src").rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("open", (share * F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("most").over(up), F.lit(0.0))) / F.sum("w").over(rest))
    # `open`: what a unit of weight gets if all sources before this one stop; the first that need not stop sets it for all
    level = F.min(F.when(F.col("open") <= F.col("level"), F.struct("level", "src", "open"))).over(Window.partitionBy())["open"]
    target = F.least("most", F.coalesce(F.col("w") * level, F.col("most")))
    return s.select("src", "source", "source_size", target.alias("target"))


def permuted(x: Column, n: Column, key: Column) -> Column:
    """x under a pseudorandom permutation of 0 to n - 1, another one for each value of the long key.

    Each round swaps x and its mirror image about a random point, or not, by a hash bit of the pair.
    """

    def turn(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(key, r), n) - x, n)
        return F.when(F.xxhash64(F.greatest(x, mirror), key, r) > 0, mirror).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, turn)


def running(rows: DataFrame, by: str, order: str, value: str, name: str) -> DataFrame:
    """rows (one for each by and order) with the sum of `value` over the smaller orders of the same `by`.

    Orders are taken SPAN at a time, and then the sums of these groups are, so that no task sorts all orders of one `by`.
    """
    group = F.floor(F.col(order) / SPAN).alias("_group")
    rows = rows.withColumn("_group", group)
    sums = rows.groupBy(by, "_group").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(by).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0).cast("long"))).drop("_sum")
    inner = Window.partitionBy(by, "_group").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_here", F.coalesce(F.sum(value).over(inner), F.lit(0).cast("long")))
    return rows.join(sums, [by, "_group"]).withColumn(name, F.col("_before") + F.col("_here")).drop("_group", "_before", "_here")


def drawn(spark: SparkSession, source: DataFrame, seed: int) -> DataFrame:
    """(shard, src, n): how many slots of each output shard fall on each source, by one multinomial draw a shard.

    source: (src, slots). Shards have SHARD slots each, but for the last. The sources' running shares are one array, in which each
    slot looks up its random place by halving steps; a shard's slots are counted where they are drawn.
    """
    ends = F.sum("slots").over(Window.orderBy("src"))  # one row for each source
    some = source.filter("slots > 0")
    levels = max(1, some.count().bit_length())
    shares = some.withColumn("end", ends).agg(F.array_sort(F.collect_list(F.struct("end", "src"))).alias("e"), F.coalesce(F.max("end"), F.lit(0).cast("long")).alias("total"))
    shards = F.ceil(F.col("total") / SHARD)
    rows = shares.filter("total > 0").select(F.col("e.end").alias("ends"), F.col("e.src").alias("srcs"), "total", F.explode(F.sequence(F.lit(0).cast("long"), shards - 1)).alias("shard"))
    # shards are dealt out before their slots are made, as they look small
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard")
    slot = F.explode(F.sequence(F.col("shard") * SHARD, F.least((F.col("shard") + 1) * SHARD, F.col("total")) - 1))
    rows = rows.select("ends", "srcs", "total", "shard", slot.alias("slot"))
    rows = rows.withColumn("place", F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), "slot"), F.col("total"))).withColumn("at", F.lit(0))
    for step in (1 << k for k in reversed(range(levels))):  # at: how many ends are not above the place
        rows = rows.withColumn("at", F.col("at") + F.when(F.get("ends", F.col("at") + step - 1) <= F.col("place"), step).otherwise(0))
    return rows.select("shard", F.get("srcs", F.col("at")).alias("src")).groupBy("shard", "src").agg(F.count("*").alias("n"))


def mixture(sizes: DataFrame, block: int = BLOCK, seed: int = 7, repeats: int = REPEATS, **shares) -> tuple[DataFrame, DataFrame]:
    """(documents, parts): what the mix takes.

    sizes: (doc_id, mark, source, size), as measured() gives it. documents: its rows with src, source_size, target and
    start, a document's first word in its source. parts: one row for each part of a document in a taken block: shard,
    pass, src, start, first (the part's first word in the document) and words. A source's parts hold its target, rounded to words; a word is
    taken `repeats` times at most. A null doc_id or source is a value like others; a null text has size 0, and a document or source without
    words takes none. Rows of equal (source, doc_id, size, mark) stand next to each other and are interchangeable. Empty tables give no rows; other columns are not carried.
    """
    spark = sizes.sparkSession
    n = max(1, sizes.count())
    each = sizes.groupBy("source", "doc_id", "size", "mark").agg(F.count("*").alias("copies"), F.sum("size").alias("here"))
    each = each.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(-(-n // BUCKET))))
    source = saved(targets(sizes, repeats=repeats, **shares), "targets")  # one row for each source
    rows = each.join(source.select("src", F.col("source").alias("of"), "source_size", "target"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    bucket = running(rows.groupBy("src", "bucket").agg(F.sum("here").alias("in_bucket")), "src", "bucket", "in_bucket", "offset").drop("in_bucket")
    ahead = Window.partitionBy("src", "bucket").orderBy("doc_id", "size", "mark").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("ahead", F.coalesce(F.sum("here").over(ahead), F.lit(0)))
    rows = rows.join(bucket, ["src", "bucket"]).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    start = F.col("offset") + F.col("ahead") + F.col("copy") * F.col("size")
    documents = rows.select("doc_id", "mark", "source", "size", "src", "source_size", "target", start.alias("start"))

    # Blocks: each document's part in each block that it touches.
    last = F.floor((F.col("start") + F.col("size") - 1) / block)
    parts = documents.filter("size > 0").select("src", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block), last)).alias("block"))
    low = F.greatest("start", F.col("block") * block)
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    parts = parts.select("src", "block", "start", (low - F.col("start")).alias("first"), (low - F.col("block") * block).alias("inner"), (high - low).alias("words"))

    # Slots: whole passes over all blocks, then blocks of the permutation until the target is reached.
    size, want = F.col("source_size"), F.least(F.round("target").cast("long"), F.col("source_size") * repeats)
    passes = F.floor(F.col("want") / size)
    slots = source.filter("source_size > 0").withColumn("want", want).select(
        "src", "want", F.col("source_size").alias("size"), F.ceil(size / block).alias("blocks"), F.floor(size / block).alias("full"),
        (passes * F.ceil(size / block) + F.ceil((F.col("want") - passes * size) / block)).alias("slots"),
    )
    counts_ = running(saved(drawn(spark, slots, seed), "draw"), "src", "shard", "n", "drawn_before")
    got = counts_.groupBy("src").agg(F.sum("n").alias("drawn"))  # one row for each source
    # in whole numbers: slots before a shard = drawn before * slots / drawn, rounded down; a source that drew none has all its slots in shard 0
    scaled = lambda x: F.floor(x.cast("decimal(38,0)") * F.col("slots") / F.col("drawn")).cast("long")
    counts_ = counts_.join(got, "src").join(slots, "src").withColumn("from", scaled(F.col("drawn_before"))).withColumn("to", scaled(F.col("drawn_before") + F.col("n")))
    rest = slots.filter("slots > 0").join(got.select("src"), "src", "left_anti").withColumn("shard", F.lit(0).cast("long")).withColumn("from", F.lit(0).cast("long")).withColumn("to", F.col("slots"))
    columns = ["shard", "src", "want", "size", "blocks", "full", "from", "to"]
    # spread before slots are made, as the rows of a source's shards lie together and look small
    slots = counts_.select(*columns).unionByName(rest.select(*columns)).filter("to > from").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "src", "shard")
    slots = slots.select("*", F.explode(F.sequence("from", F.col("to") - 1)).alias("slot"))
    number, turn = F.col("slot") % F.col("blocks"), F.floor(F.col("slot") / F.col("blocks"))
    slots = slots.withColumn("pass", turn).withColumn("number", number).withColumn("key", F.xxhash64(F.lit(seed), "src", "pass"))
    # the shorter last block ends a whole pass; in the last pass, which may stop before it, as many words as are wanted are taken of any block
    place = F.when(F.col("number") < F.col("full"), permuted(F.col("number"), F.col("full"), F.col("key"))).otherwise(F.col("number"))
    left = F.col("want") - F.col("pass") * F.col("size") - F.col("number") * block
    slots = slots.select("shard", "pass", "src", place.alias("block"), F.least(F.lit(block).cast("long"), left).alias("left"))
    taken = slots.join(parts.hint("merge"), ["src", "block"]).withColumn("words", F.least("words", F.col("left") - F.col("inner")))
    return documents, taken.filter("words > 0").select("shard", "pass", "src", "start", "first", "words")


def counts(parts: DataFrame) -> DataFrame:
    """(shard, src, words): the draw, as each shard's words by source."""
    return parts.groupBy("shard", "src").agg(F.sum("words").alias("words"))


def mixed_texts(docs: DataFrame, sizes: DataFrame, **options) -> DataFrame:
    """The mix as documents: for each pass over its source, a document's taken words, with docs' columns.

    A document that a pass takes whole keeps its text; of another, the taken words remain, in order, joined by spaces.
    Documents of which nothing is taken, or without words, are absent; rows equal in doc_id and text get the same.
    """
    documents, parts = mixture(sizes, **options)
    taken = parts.groupBy("src", "start", "pass").agg(F.sort_array(F.collect_list(F.struct("first", "words"))).alias("_parts"), F.sum("words").alias("_taken"))
    key = documents.filter("size > 0").select("src", "start", F.col("doc_id").alias("_id"), F.col("mark").alias("_m"), F.col("size").alias("_size"))
    wanted = taken.join(key, ["src", "start"]).dropDuplicates(["_id", "_m", "pass"]).select("_id", "_m", "_size", "_parts", "_taken")
    both = docs.join(wanted.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_m")))
    part = F.col("_taken") < F.col("_size")
    # the words are bound by the outer transform, so that they are split once and not for each part
    cut = lambda every: F.flatten(F.transform(F.col("_parts"), lambda p: F.slice(every, p["first"].cast("int") + 1, p["words"].cast("int"))))
    some = F.transform(F.array(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))), cut)
    text = F.when(part, F.array_join(F.get(some, 0), " ")).otherwise(F.col("text"))
    return both.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and shards: where the mix puts a document's words, as (shard, words) by shard."""
    documents, parts = mixture(measured(table(spark, sf_dir, "documents")))
    taken = parts.groupBy("src", "start", "shard").agg(F.sum("words").alias("words"))
    taken = taken.groupBy("src", "start").agg(F.sum("words").alias("t"), F.sort_array(F.collect_list(F.struct("shard", "words"))).alias("in_shards"))
    key = F.when(F.col("size") > 0, F.col("start"))  # a document without words shares its start with the next one
    both = documents.withColumn("key", key).join(taken.select(F.col("src").alias("s"), F.col("start").alias("k"), "t", "in_shards"), (F.col("src") == F.col("s")) & (F.col("key") == F.col("k")), "left")
    none = F.array().cast("array<struct<shard:bigint,words:bigint>>")
    return both.select("doc_id", "size", "source_size", "target", F.coalesce("t", F.lit(0)).cast("long").alias("taken"), F.coalesce("in_shards", none).alias("shards"))
