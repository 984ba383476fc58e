"""A training-data pipeline over documents: quality, line dedup, near-duplicates, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet to the shared folder and read
again as the next stage's docs. All but the last return the columns of documents, whatever others docs has beside doc_id and text.

Null and empty texts have no words: the classifier gives them its bias, no stage of copies takes them for anyone's, the mix takes
nothing of them, so that they don't reach the windows. A null doc_id or source is a value like others; repeated rows are one document's copies, of which the
third stage keeps one. An empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import jaccard_join, line_dedup, mixing, packing, quality
from quern.llm.common import drop_saved, saved, scratch, table


def _as(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents; n_chars again counts the text that there is now."""
    n = F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)
    return docs.withColumn("n_chars", n).select(*columns)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score of 0.5 or more), with their text as it is."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.predict(docs, model, score="_score", predicted="_good").filter("_good = 1").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of lines that stand in an earlier place; one that loses all its words goes."""
    left = line_dedup.dedup_lines(docs, n_lines="_lines_in", n_removed="_lines_out").filter((F.col("_lines_out") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return _as(left, docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the least doc_id."""
    return jaccard_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: one row for each pass over its source, with the words taken in it."""
    return _as(mixing.mixed_texts(docs, mixing.measured(docs)), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 1,024 tokens."""
    return packing.pack(docs, packing.byte_bpe())


STAGES = [
    ("quality", keep_good),
    ("line_dedup", drop_lines),
    ("near_copies", drop_near_copies),
    ("mix", mix_sources),
    ("pack", pack),
]

#: Hashed samples, MinHash and a learned classifier are beyond SQL; tests/llm compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir. A stage's own tables go when it ends, and its input when the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        with scratch(spark):
            kept = saved(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
        if i:
            drop_saved(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
